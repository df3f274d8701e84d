"""Validation: the post-clean check suite, declared constraints, quarantine
and the six data-quality queries (dq1-dq6).

A rule says of a row whether it is a violation; a check counts violations, of a
rule or of the table as a whole. A suite evaluates all of its checks in ONE
aggregate over the table and unpivots the result to rows ``(check_name,
violations, passed)``. Null handling follows the reference's pandas checks: a null
compares as False, so nulls fail the non-negative, money-order and
submit-after-service checks but pass the denied-reason check.

``quarantine`` runs a table's plan once: the rows are written apart by whether they
break a rule, those that do tagged with all the rules they break, and the counters are
observed while these are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, round_half_up
from claimwise.session import PACKED, forget_shuffles, materialize, scratch
from claimwise.sources.joins import checked_broadcast, estimated_bytes, max_bytes

MONEY_TOLERANCE = 0.01


class CheckFailed(AssertionError):
    pass


@dataclass(frozen=True)
class Unique:
    """Violations: rows beyond the first of each ``key``, and rows without."""

    key: str


Check = Column | Unique


def _not(pred: Column) -> Column:
    """Violation when ``pred`` is not true (null counts as a violation)."""
    return ~F.coalesce(pred, F.lit(False))


def domain_violations(col: str, domain: tuple) -> Column:
    """The set of values must EQUAL ``domain``: rows outside it (or null)
    plus domain values that never occur. Bounded state: one counter per
    domain value, no collected sets."""
    outside = count_if(_not(F.col(col).isin(*domain)))
    missing = sum(
        (F.when(count_if(F.col(col) == F.lit(v)) == 0, F.lit(1)).otherwise(F.lit(0)) for v in domain),
        F.lit(0),
    )
    return (outside + missing).cast("bigint")


def claim_rules(cfg: ClaimsConfig = DEFAULT) -> dict[str, Check]:
    """What is wrong with a single claim, by check."""
    b, a, p = F.col(cfg.billed), F.col(cfg.allowed), F.col(cfg.paid)
    tol = F.lit(MONEY_TOLERANCE)
    is_denied = F.col(cfg.status) == F.lit(cfg.status_denied)
    return {
        "chk_claim_id_unique": Unique(cfg.claim_id),
        "chk_billed_present": b.isNull(),
        "chk_non_negative": _not((b >= 0) & (a >= 0) & (p >= 0)),
        "chk_money_order": _not((p <= a + tol) & (a <= b + tol)),
        "chk_submit_after_service": _not(F.datediff(F.col(cfg.submission_date), F.col(cfg.service_date)) >= 0),
        "chk_status_domain": _not(F.col(cfg.status).isin(*cfg.statuses)),
        "chk_denied_reason": is_denied & (F.col(cfg.reason) == F.lit(cfg.no_reason)),
        "chk_pending_no_date": (F.col(cfg.status) == F.lit(cfg.status_pending)) & F.col(cfg.processed_date).isNotNull(),
        "chk_patient_match": F.col(cfg.plan_type).isNull(),
        "chk_provider_match": F.col(cfg.specialty).isNull(),
    }


def as_checks(rules: dict[str, Check]) -> dict[str, Check]:
    """Rules as counters of the rows that break them."""
    return {n: r if isinstance(r, Unique) else count_if(r) for n, r in rules.items()}


def claim_checks(cfg: ClaimsConfig = DEFAULT) -> dict[str, Check]:
    """The rules as counters; the status check also asks that each status occurs."""
    return as_checks(claim_rules(cfg)) | {"chk_status_domain": domain_violations(cfg.status, cfg.statuses)}


def patient_checks(cfg: ClaimsConfig = DEFAULT) -> dict[str, Check]:
    return {
        "chk_gender_mapped": count_if(F.col(cfg.gender).isNull()),
        "chk_patient_id_unique": Unique(cfg.patient_id),
    }


def provider_checks(cfg: ClaimsConfig = DEFAULT) -> dict[str, Check]:
    return {"chk_provider_id_unique": Unique(cfg.provider_id)}


def _hash(key: str) -> Column:
    """Of a key, 8 bytes; null without one."""
    return F.when(F.col(key).isNotNull(), F.xxhash64(key))


def _shared_hashes(rows: DataFrame, key: str) -> DataFrame:
    """Hashes (``_h``) of more rows than one, a table of its own. Only they need to be
    told by their keys: a hash of one row is a key of one row."""
    return materialize(rows.select(_hash(key).alias("_h")).where("_h IS NOT NULL").groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h"))


def _keys_sharing(rows: DataFrame, key: str, hashes: DataFrame) -> DataFrame:
    """(_k, _n): the keys with one of ``hashes``, and their rows."""
    near = rows.select(F.col(key).alias("_k"), _hash(key).alias("_h")).join(checked_broadcast(hashes), "_h", "left_semi")
    return near.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"))


def _extra_rows(keys: DataFrame, key: str, name: str, stored: bool = False) -> DataFrame:
    """One row: how many rows are beyond the first of their key, or without one. Of a
    ``stored`` table, which may be read twice, the hashes of all keys are counted and then
    the keys of repeated hashes, so few keys are shuffled; else the keys are."""
    if stored:
        again = _keys_sharing(keys, key, _shared_hashes(keys, key))
        none = keys.agg(count_if(F.col(key).isNull()).alias("_none"))
        extra = again.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_extra"))
        return none.crossJoin(F.broadcast(extra)).select((F.col("_none") + F.col("_extra")).cast("bigint").alias(name))  # one row each
    sizes = keys.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    extra = F.col("_n") - F.when(F.col("_k").isNull(), F.lit(0)).otherwise(F.lit(1))
    return sizes.agg(F.coalesce(F.sum(extra), F.lit(0)).cast("bigint").alias(name))


def _results(counts: DataFrame, names: list[str]) -> DataFrame:
    """One row with counters ``_c0`` ... -> (check_name, violations, passed)."""
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"_c{i}").alias("violations")) for i, n in enumerate(names)])
    return counts.select(F.inline(rows)).withColumn("passed", F.col("violations") == 0)


def run_checks(df: DataFrame, checks: dict[str, Check], keys: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Evaluate a suite -> (check_name, violations, passed). All counters come
    from one plain aggregate; each uniqueness check counts its key alone, so
    counters do not travel with the keys. The one-row results are joined.
    ``keys``: a table with the same rows that uniqueness may read instead, where
    ``df`` has joins that a key does not need. ``stored``: what uniqueness reads is a
    table, not a plan that each reading runs again."""
    names = list(checks)
    plain = {n: c for n, c in checks.items() if not isinstance(c, Unique)}
    a = df.agg(F.count(F.lit(1)).alias("_rows"), *[c.cast("bigint").alias(f"_c{names.index(n)}") for n, c in plain.items()])
    for n, c in checks.items():
        if isinstance(c, Unique):
            one = _extra_rows(df if keys is None else keys, c.key, f"_c{names.index(n)}", stored)
            a = a.crossJoin(F.broadcast(one))  # one row each
    return _results(a, names)


def assert_checks(result: DataFrame) -> DataFrame:
    """Raise when any check failed (the result is a handful of rows)."""
    failed = [r["check_name"] for r in result.where(~F.col("passed")).select("check_name").collect()]
    if failed:
        raise CheckFailed("failed checks: " + ", ".join(failed))
    return result


@dataclass(frozen=True)
class Quarantine:
    """``good``: rows that break no rule, as they came. ``rejected``: the others with
    ``reject_reasons``, all rules they break in the order of the rules. ``counts``:
    rows that break each rule (check_name, violations, passed)."""

    good: DataFrame
    rejected: DataFrame
    counts: DataFrame
    rows: int
    rejected_rows: int


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written as a table with a number for each row, and that column's name."""
    row = "_row"
    while row in df.columns:
        row += "_"
    return materialize(df.withColumn(row, F.monotonically_increasing_id())), row


def _marks(rows: DataFrame, key: str, hashes: DataFrame, row: str) -> DataFrame:
    """(_w, _b): a bit for each row that has one of ``hashes``, in words of 64 rows by
    their numbers, a table of its own. Hashes and numbers are all that is dealt out."""
    near = rows.select(_hash(key).alias("_h"), F.col(row).alias("_r")).join(checked_broadcast(hashes), "_h", "left_semi")
    words = near.groupBy(F.shiftright("_r", 6).alias("_w"))
    return materialize(words.agg(F.bit_or(F.expr("shiftleft(1L, CAST(_r & 63 AS INT))")).alias("_b")))


def tagged(df: DataFrame, rules: dict[str, Check], name: str = "reject_reasons", keys: DataFrame | None = None, stored: bool = False) -> DataFrame:
    """Every row with the names of the rules it breaks (an array, in their order).
    Of rows that share a ``Unique`` key none can be trusted, so all are tagged, and
    so are rows without a key.

    For such rules the rows are written once as a table (unless they are ``stored`` in one)
    and read again. 8 bytes a row,
    hashes of the key (from ``keys`` where given), are counted; the rows of repeated hashes
    are then looked up by the hash, so that the rows themselves need not be dealt out by
    key, and keys that only share a hash with another (next to none) are taken out again:
    the hash filters, it never decides. Where the repeated hashes are too many to broadcast,
    hashes and row numbers are dealt out instead of the rows, and come back as one bit a row."""
    row = None
    if not stored and any(isinstance(r, Unique) for r in rules.values()):
        df, row = _numbered(df)
    df, predicates, own = _looked_up(df, rules, keys, row)
    return df.withColumn(name, _reasons(predicates)).drop(*own)


def _reasons(predicates: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]))


def _looked_up(df: DataFrame, rules: dict[str, Check], keys: DataFrame | None, row: str | None) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """A table (with row numbers in ``row``, or without any) with columns that tell of
    its keys; all rules as predicates over it; and the names of these columns."""
    table, predicates, own = df, {}, [] if row is None else [row]
    for i, (n, rule) in enumerate(rules.items()):
        if isinstance(rule, Unique):
            h, k, w, b, all_keys = f"_h{i}", f"_k{i}", f"_w{i}", f"_b{i}", table if keys is None else keys
            hashes = _shared_hashes(all_keys, rule.key)
            if keys is None and row is not None and estimated_bytes(hashes) > max_bytes(hashes):
                marks = checked_broadcast(_marks(table, rule.key, hashes, row).select(F.col("_w").alias(w), F.col("_b").alias(b)))
                marked = lambda rows: rows.join(marks, F.shiftright(row, 6) == F.col(w), "left")  # noqa: B023, E731
                near = F.coalesce(F.getbit(F.col(b), F.expr(f"CAST(`{row}` & 63 AS INT)")), F.lit(0)) == 1
                sizes = marked(table.select(rule.key, row)).where(near).groupBy(F.col(rule.key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
                df = marked(df)
                own += [w, b]
            else:
                sizes = _keys_sharing(all_keys, rule.key, hashes)
                df = df.join(checked_broadcast(hashes.select(F.col("_h").alias(h))), _hash(rule.key) == F.col(h), "left")
                near = F.col(h).isNotNull()
                own.append(h)
            alone = materialize(sizes.where("_n = 1").select(F.col("_k").alias(k)))
            df = df.join(checked_broadcast(alone), F.col(rule.key) == F.col(k), "left")
            predicates[n] = F.col(rule.key).isNull() | (near & F.col(k).isNull())
            own.append(k)
        else:
            predicates[n] = rule
    return df, predicates, own


def quarantine(df: DataFrame, rules: dict[str, Check], path: str | None = None, keys: DataFrame | None = None) -> Quarantine:
    """Write the rows of ``df``, good and rejected ones apart, and count violations on the
    way (``observe`` in the writing stage, whose tasks count once each). Both parts
    are read back from ``path`` (default: a folder below the checkpoint folder). Each part
    is a write of its own over a table of ``df``: one write of both has to sort all rows."""
    spark = df.sparkSession
    names, reasons, apart = list(rules), "reject_reasons", "_rejected"
    path = path or scratch(spark, "quarantine")
    table, row = _numbered(df)
    forget_shuffles(spark)  # of the joins behind df
    rows, predicates, own = _looked_up(table, rules, keys, row)
    forget_shuffles(spark)  # of the keys
    broken = F.lit(False)
    for p in predicates.values():
        broken = broken | F.coalesce(p, F.lit(False))
    said = {False: F.array().cast("array<string>"), True: _reasons(predicates)}  # only rows that are rejected need more than a yes or no
    counts = [count_if(F.array_contains(reasons, n)).alias(f"_c{i}") for i, n in enumerate(names)]
    places, got = {}, []
    for bad in (False, True):
        places[bad], seen = f"{path}/{apart}={str(bad).lower()}", Observation()
        part = rows.where(broken == F.lit(bad)).withColumn(reasons, said[bad]).drop(*own)
        part = part.observe(seen, F.count(F.lit(1)).alias("rows"), *(counts if bad else ()))
        part.write.option("compression", PACKED).parquet(places[bad])
        got.append(seen.get)
    schema = ", ".join(f"_c{i} long" for i in range(len(names)))
    table = _results(spark.createDataFrame([tuple(got[1][f"_c{i}"] or 0 for i in range(len(names)))], schema), names)
    good, rejected = (spark.read.schema(part.schema).parquet(places[bad]) for bad in (False, True))
    return Quarantine(good.drop(reasons), rejected, table, sum(g["rows"] for g in got), got[1]["rows"])


# ---------------------------------------------------------------- declared constraints

# The declared NOT NULL columns and CHECK lists of the
# reference's star schema (processed_date is the one nullable fact column).
NOT_NULL = {
    "patients": ("gender", "date_of_birth", "state", "plan_type", "enrollment_date"),
    "providers": ("provider_name", "specialty", "state", "network_status"),
    "claims": (
        "patient_id", "provider_id", "service_date", "submission_date", "claim_type", "diagnosis_category",
        "cpt_code", "billed_amount", "allowed_amount", "paid_amount", "claim_status", "denial_reason",
        "billed_imputed",
    ),
}
IN_LIST = {
    "patients": {"gender": ("Female", "Male"), "plan_type": ("Commercial", "Medicare", "Medicaid")},
    "providers": {"network_status": ("In-Network", "Out-of-Network")},
    "claims": {"claim_status": ("Paid", "Denied", "Pending")},
}
PRIMARY_KEY = {"patients": "patient_id", "providers": "provider_id", "claims": "claim_id"}
NON_NEGATIVE = {"claims": ("billed_amount", "allowed_amount", "paid_amount")}


def constraint_checks(table: str, columns: list[str], not_null=None, in_list=None, pk=None,
                      non_negative=None) -> dict[str, Check]:
    """Violations of the declared constraints of ``table`` (only for the
    columns present). A CHECK passes on null (caught by NOT NULL instead)."""
    not_null = NOT_NULL.get(table, ()) if not_null is None else not_null
    in_list = IN_LIST.get(table, {}) if in_list is None else in_list
    pk = PRIMARY_KEY.get(table) if pk is None else pk
    non_negative = NON_NEGATIVE.get(table, ()) if non_negative is None else non_negative
    out: dict[str, Check] = {}
    if pk and pk in columns:
        out[f"con_primary_key.{pk}"] = Unique(pk)
    for c in not_null:
        if c in columns:
            out[f"con_not_null.{c}"] = count_if(F.col(c).isNull())
    for c, values in in_list.items():
        if c in columns:
            out[f"con_in_list.{c}"] = count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values))
    for c in non_negative:
        if c in columns:
            out[f"con_non_negative.{c}"] = count_if(F.col(c) < 0)
    return out


def with_default(df: DataFrame, col: str, value) -> DataFrame:
    """DEFAULT clause: a missing value takes the default."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


def foreign_key_violations(fact: DataFrame, dim: DataFrame, fk: str, pk: str, name: str) -> DataFrame:
    """Fact rows whose key has no match in the dimension. The fact is counted
    per key before the join, so a hot key is one row there."""
    keys = fact.groupBy(F.col(fk).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
    lost = keys.join(dim.select(F.col(pk).alias("_pk")), F.col("_fk") == F.col("_pk"), "left_anti")
    return lost.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias(name))


# ---------------------------------------------------------------- dq1-dq6

def dq_row_counts(claims: DataFrame, patients: DataFrame, providers: DataFrame) -> DataFrame:
    """dq1: (table_name, row_count) of the three tables."""
    parts = [
        t.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, t in (("patients", patients), ("providers", providers), ("claims", claims))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def dq_orphans(claims: DataFrame, patients: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """dq2: claims pointing at a missing patient / provider."""
    pa = foreign_key_violations(claims, patients, cfg.patient_id, cfg.patient_id, "orphan_patient_rows")
    pr = foreign_key_violations(claims, providers, cfg.provider_id, cfg.provider_id, "orphan_provider_rows")
    return pa.crossJoin(F.broadcast(pr))  # one row each


def dq_financial(claims: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """dq3: paid > allowed + .01; allowed > billed + .01; denied but paid."""
    tol = F.lit(MONEY_TOLERANCE)
    return claims.agg(
        count_if(F.col(cfg.paid) > F.col(cfg.allowed) + tol).alias("paid_gt_allowed"),
        count_if(F.col(cfg.allowed) > F.col(cfg.billed) + tol).alias("allowed_gt_billed"),
        count_if((F.col(cfg.status) == F.lit(cfg.status_denied)) & (F.col(cfg.paid) > 0)).alias("denied_but_paid"),
    )


def dq_dates(claims: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """dq4: submitted before service; processed before submitted; pending
    with a decision date; decided without one."""
    pending = F.col(cfg.status) == F.lit(cfg.status_pending)
    return claims.agg(
        count_if(F.col(cfg.submission_date) < F.col(cfg.service_date)).alias("submitted_before_service"),
        count_if(F.col(cfg.processed_date) < F.col(cfg.submission_date)).alias("processed_before_submitted"),
        count_if(pending & F.col(cfg.processed_date).isNotNull()).alias("pending_with_decision"),
        count_if(~pending & F.col(cfg.processed_date).isNull()).alias("decided_without_date"),
    )


def dq_denied_without_reason(claims: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """dq5."""
    return claims.agg(
        count_if((F.col(cfg.status) == F.lit(cfg.status_denied)) & (F.col(cfg.reason) == F.lit(cfg.no_reason))).alias(
            "denied_without_reason"
        )
    )


def dq_imputed_share(claims: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """dq6: imputed billed rows and their % of all rows (2 dp)."""
    a = claims.agg(
        F.sum(F.col(cfg.billed_imputed).cast("int")).cast("bigint").alias("imputed_rows"),
        F.count(F.lit(1)).alias("_n"),
    )
    return a.select(
        "imputed_rows",
        round_half_up(F.try_divide(F.col("imputed_rows").cast("double") * F.lit(100.0), F.col("_n").cast("double")), 2).alias("imputed_pct"),
    )
