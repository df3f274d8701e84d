"""Readers and writers: raw CSV exports, typed tables (strict, or cell by cell with
what is wrong), clean tables and the denormalised extract. The star's tables are
loaded by ``sources/star.py``, query results kept by ``plans/results.py``.

Paths are arguments; on a cluster they point at shared storage. Nothing
here collects data to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.functions import strip_ws
from claimwise.schema import CONVENIENCE, FACT_COLUMNS
from claimwise.sources.joins import checked_broadcast


# Texts that stand for a missing value in the exports.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, schema, missing: tuple = MISSING_TOKENS, header: bool = True) -> DataFrame:
    """Raw export (with a header unless told otherwise), every column as text (no
    inference); a missing-value token becomes null. A row with too many or too few fields
    keeps its whole line in ``_corrupt_record`` (null for good rows): see
    ``split_corrupt``."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = (
        spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", CORRUPT).option("encoding", "UTF-8").option("quote", '"')
        .option("escape", '"').csv(path)
    )
    return rows.select(*[F.when(~F.col(c).isin(*missing), F.col(c)).alias(c) for c in schema.names], CORRUPT)


def split_corrupt(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, lines that do not) of a raw export. Spark
    does not read the corrupt column alone, so both also ask for the others."""
    all_read = F.length(F.concat_ws("", *[c for c in raw.columns if c != CORRUPT])) >= 0
    good = raw.where(F.col(CORRUPT).isNull() & all_read).drop(CORRUPT)
    return good, raw.where(F.col(CORRUPT).isNotNull() & all_read).select(F.col(CORRUPT).alias("line"))


def typed_cell(text: Column, kind: T.DataType) -> Column:
    """A cell's text as a value of the declared type; null if it is none. Dates are
    ISO, numbers may have white space around them, flags are true or false."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.DateType):
        return F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}\s*$"), F.try_to_date(strip_ws(text), "yyyy-MM-dd"))
    if isinstance(kind, T.IntegralType):  # try_cast would cut off a fraction
        return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), strip_ws(text).try_cast(kind))
    return strip_ws(text).try_cast(kind)


def read_typed(spark: SparkSession, path: str, schema: T.StructType, missing: tuple = MISSING_TOKENS, header: bool = True) -> DataFrame:
    """Typed table from text in which each cell is converted by itself: a cell that is
    no value of its type becomes null and its row stays. ``cell_errors`` (empty for
    good rows) says what is wrong: ``column``, the ``text`` that was there, and the
    ``problem``, one of ``not a <type>``, ``missing`` (in a column declared NOT NULL)
    and, with no column and the whole line, ``too many or too few fields``."""
    raw = read_raw(spark, path, _as_text(schema), missing, header)
    error = lambda column, text, problem: F.struct(F.lit(column).cast("string").alias("column"), text.alias("text"), F.lit(problem).alias("problem"))
    cells, errors = {}, [F.when(F.col(CORRUPT).isNotNull(), error(None, F.col(CORRUPT), "too many or too few fields"))]
    for f in schema.fields:
        text = F.col(f.name)
        cells[f.name] = typed_cell(text, f.dataType)
        if not isinstance(f.dataType, T.StringType):
            errors.append(F.when(text.isNotNull() & cells[f.name].isNull(), error(f.name, text, f"not a {f.dataType.simpleString()}")))
        if not f.nullable:
            errors.append(F.when(text.isNull(), error(f.name, text, "missing")))
    return raw.select(*[c.alias(n) for n, c in cells.items()], F.array_compact(F.array(*errors)).alias("cell_errors"))


def _as_text(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def split_errors(typed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a bad cell, one row per bad cell with the columns of the row)."""
    good = typed.where(F.size("cell_errors") == 0).drop("cell_errors")
    bad = typed.select("*", F.explode("cell_errors").alias("error")).drop("cell_errors").select("*", "error.*").drop("error")
    return good, bad


def read_clean(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    """Clean table with declared types; CSV is parsed strictly (a malformed
    row fails the job instead of turning into nulls)."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (
        spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("encoding", "UTF-8")
        .option("quote", '"').option("dateFormat", "yyyy-MM-dd").csv(path)
    )


def write_clean(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write each clean table under ``path/<name>``; CSV gets a header and
    ISO dates."""
    for name, df in tables.items():
        w = df.write.mode(mode)
        if fmt == "csv":
            w.option("header", True).option("dateFormat", "yyyy-MM-dd").csv(f"{path}/{name}")
        else:
            w.parquet(f"{path}/{name}")


def fact_columns(wide: DataFrame) -> DataFrame:
    """The 15 fact columns of the star's fact table; the imputation flag
    as 0/1."""
    cols = [c for c in FACT_COLUMNS if c in wide.columns]
    return wide.select(*cols).withColumn("billed_imputed", F.col("billed_imputed").cast("int"))


def drop_convenience(wide: DataFrame) -> DataFrame:
    """Drop the wide file's columns that the dimensions supply."""
    return wide.drop(*CONVENIENCE)


# Column order of the denormalised extract.
EXTRACT_COLUMNS = [
    "claim_id", "month_key", "service_date", "plan_type", "provider_id", "provider_name", "specialty",
    "network_status", "claim_type", "diagnosis_category", "billed_amount", "allowed_amount", "paid_amount",
    "claim_status", "denial_reason", "days_to_process", "age_group",
]


def claims_extract(wide: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """17-column extract of the claims with a known provider, ordered by
    (service_date, claim_id) - a global sort, range-partitioned by Spark. Where
    ``wide`` already carries ``provider_name`` (which no provider lacks), the fact
    does not meet the provider dimension again; else ``providers`` supplies it."""
    if "provider_name" in wide.columns:
        j = wide.where(F.col("provider_name").isNotNull())
    else:
        names = checked_broadcast(providers.select(F.col("provider_id").alias("_pk"), "provider_name"))
        j = wide.join(names, wide["provider_id"] == names["_pk"]).drop("_pk")
    j = j.withColumn("month_key", (F.year("service_date") * 100 + F.month("service_date")).cast("int"))
    return j.select(*EXTRACT_COLUMNS).orderBy("service_date", "claim_id")


def write_extract(extract: DataFrame, path: str) -> None:
    extract.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
