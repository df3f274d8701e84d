"""A claims star with every kind of fault that validation looks for.

Deterministic test data over the driver's tables: a claim's order number (or
a dimension's key) modulo a prime says which fault it gets. The rules are
SQL text that Spark and DuckDB read alike, so both engines see the same
faulty rows; what is checked on them is written separately for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.operators.clean import CLAIM_MONEY
from claimwise.schema import RAW_CLAIMS
from claimwise.session import prepared, scratch
from claimwise.sources import files, tpch

CLAIM_FAULT = "CAST(split_part(claim_id, '-', 1) AS BIGINT) % 97"
_M = "CAST({} AS DECIMAL(18,2))"
#: column -> {fault number: expression}; a column not named here stays.
CLAIM_RULES = {
    "claim_id": {23: "CAST(NULL AS VARCHAR(60))"},
    "patient_id": {9: "-patient_id", 15: "CAST(NULL AS BIGINT)"},
    "provider_id": {10: "CAST(-1 AS BIGINT)", 16: "CAST(NULL AS BIGINT)"},
    "service_date": {14: "CAST(NULL AS DATE)"},
    "submission_date": {5: "service_date - 3", 17: "CAST(NULL AS DATE)"},
    "processed_date": {8: "submission_date + 5", 26: "CAST(NULL AS DATE)", 27: "submission_date - 2"},
    "claim_type": {11: "CAST(NULL AS VARCHAR(60))"},
    "diagnosis_category": {13: "CAST(NULL AS VARCHAR(60))"},
    "cpt_code": {12: "CAST(NULL AS VARCHAR(60))"},
    "billed_amount": {2: _M.format("NULL"), 25: _M.format("-7")},
    "allowed_amount": {18: _M.format("NULL"), 24: _M.format("-5"), 28: _M.format("billed_amount + 50")},
    "paid_amount": {3: _M.format("-1"), 4: _M.format("allowed_amount + 10"), 19: _M.format("NULL"), 29: _M.format("3")},
    "claim_status": {6: "'Weird'", 8: "'Pending'", 20: "CAST(NULL AS VARCHAR(60))", 26: "'Paid'", 27: "'Paid'", 29: "'Denied'", 30: "'Denied'"},
    "denial_reason": {21: "CAST(NULL AS VARCHAR(60))", 30: "'Not Applicable'"},
    "billed_imputed": {22: "CAST(NULL AS BOOLEAN)"},
}
PATIENT_RULES = {
    "patient_id": {9: "CAST(NULL AS BIGINT)"},
    "gender": {1: "CAST(NULL AS VARCHAR(60))", 7: "'X'"},
    "date_of_birth": {3: "CAST(NULL AS DATE)"},
    "state": {4: "CAST(NULL AS VARCHAR(60))"},
    "plan_type": {5: "CAST(NULL AS VARCHAR(60))", 8: "'Other'"},
    "enrollment_date": {6: "CAST(NULL AS DATE)"},
}
PROVIDER_RULES = {
    "provider_id": {7: "CAST(NULL AS BIGINT)"},
    "provider_name": {2: "CAST(NULL AS VARCHAR(60))"},
    "specialty": {3: "CAST(NULL AS VARCHAR(60))"},
    "state": {4: "CAST(NULL AS VARCHAR(60))"},
    "network_status": {5: "CAST(NULL AS VARCHAR(60))", 6: "'Maybe'"},
}
CLAIM_COLUMNS = [*RAW_CLAIMS.names, "billed_imputed"]


def projection(columns: list[str], rules: dict) -> list[str]:
    """SELECT items over rows with a fault number ``f``."""
    out = []
    for c in columns:
        cases = " ".join(f"WHEN {n} THEN {e}" for n, e in rules.get(c, {}).items())
        out.append(f"CASE f {cases} ELSE {c} END AS {c}" if cases else c)
    return out


def _faulty(rows: DataFrame, fault: str, rules: dict, twice: int) -> DataFrame:
    d = rows.withColumn("f", F.expr(fault))
    d = d.withColumn("_copy", F.explode(F.expr(f"CASE WHEN f = {twice} THEN array(1, 2) ELSE array(1) END")))
    return d.selectExpr(*projection(rows.columns, rules))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(sf_dir, "faulty claims", lambda: _faulty(tpch.claims(spark, sf_dir, codes=True).select(*CLAIM_COLUMNS), CLAIM_FAULT, CLAIM_RULES, 1))


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(tpch.patients(spark, sf_dir), "patient_id % 101", PATIENT_RULES, 2)


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _faulty(tpch.providers(spark, sf_dir).drop("claim_type"), "provider_id % 13", PROVIDER_RULES, 1)


#: Faults of the CSV export, by the same number: a third date spelling, a
#: missing-value token, and texts that are no amounts.
CSV_RULES = {
    "service_date": {30: "'05-03-2024'"},
    "billed_amount": {31: "'N/A'", 32: "'12,50 USD'"},
    "allowed_amount": {33: "'abc'"},
}


#: Rows of one compressed file, which one task has to read.
CSV_ROWS = 200_000


def claims_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw claims written as a CSV export with faults and read back as
    text."""
    return prepared(sf_dir, "claims csv", lambda: _claims_csv(spark, sf_dir), write=False)  # is a file already


def _claims_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tpch.raw_claims(spark, sf_dir).withColumn("f", F.expr(CLAIM_FAULT))
    text = raw.select("f", *[F.col(c).cast("string").alias(c) for c in RAW_CLAIMS.names])
    path = scratch(spark, "csv")
    text.selectExpr(*projection(RAW_CLAIMS.names, CSV_RULES)).write.option("header", True).option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).option("escape", '"').option("compression", "gzip").option("maxRecordsPerFile", CSV_ROWS).csv(path)
    return files.split_corrupt(files.read_raw(spark, path, RAW_CLAIMS))[0]


def typed(clean: DataFrame) -> DataFrame:
    """Keys of a cleaned CSV as the driver's tables have them."""
    money = {c: F.col(c).cast("decimal(18,2)") for c in CLAIM_MONEY}
    return clean.withColumns({c: F.col(c).cast("bigint") for c in ("patient_id", "provider_id")} | money)


#: Faults of the patient export, by ``patient_id % 53``.
CELL_RULES = {
    "patient_id": {3: "'P-' || patient_id"},
    "gender": {7: "'NA'"},
    "date_of_birth": {2: "'1990-13-45'", 4: "'unknown'", 8: "''"},
    "enrollment_date": {4: "'05-03-2024'"},
}
TOO_MANY, TOO_FEW = 5, 6


def patients_csv(spark: SparkSession, sf_dir: str) -> str:
    """The patients written as a CSV without header, with bad cells, missing cells, and
    lines of too many or too few fields; returns its folder."""
    rows = tpch.patients(spark, sf_dir)
    text = rows.select((F.col("patient_id") % 53).alias("f"), *[F.col(c).cast("string").alias(c) for c in rows.columns])
    cells = text.selectExpr("f", *projection(rows.columns, CELL_RULES))
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in rows.columns])
    line = F.when(F.col("f") == TOO_MANY, F.concat(line, F.lit(",surplus"))).when(F.col("f") == TOO_FEW, F.concat_ws(",", "patient_id", "gender")).otherwise(line)
    path = scratch(spark, "cells")
    cells.select(line.alias("value")).write.text(path)
    return path
