"""Cleaning of the raw exports (patients, providers, claims).

Order of the claims steps follows the reference: exact duplicates are
removed *before* normalising (so rows written differently survive), dates
are parsed per value, status is title-cased, negative billed amounts flipped,
missing billed amounts imputed from the CPT median (floored at the allowed
amount) and blank reasons filled. Amounts may come as text. Unparseable dates
and amounts never raise: the rows go to a reject table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import normalise_code, parse_date, parse_mixed_dates, strip_ws, title_case
from claimwise.operators.dedup import drop_exact_duplicates, row_hash
from claimwise.operators.ranking import group_median
from claimwise.session import materialize
from claimwise.sources.joins import checked_broadcast

MONEY = "decimal(18,2)"
CLAIM_MONEY = ("billed_amount", "allowed_amount", "paid_amount")

# The reference's code map for gender and its fill values.
GENDER_MAP = {"F": "Female", "M": "Male"}
UNKNOWN_STATE = "Unknown"


def fix_negative(df: DataFrame, col: str) -> DataFrame:
    """Negative amounts are sign errors: take the absolute value."""
    return df.withColumn(col, F.abs(F.col(col)))


def flag_missing(df: DataFrame, col: str, flag: str) -> DataFrame:
    return df.withColumn(flag, F.col(col).isNull())


def impute_with_floor(df: DataFrame, col: str, by: str, floor: str, approx: bool = False,
                      k: int = 2) -> DataFrame:
    """Missing ``col`` -> max(median of ``col`` within ``by``, ``floor``),
    rounded to ``k`` dp; existing values are rounded as well. A group whose
    values are all missing stays null (NumPy max(NaN, x) is NaN), so a later
    presence check fails instead of silently imputing the floor.

    The exact median comes from counts per amount (``group_median``), so a
    CPT code holding a third of all claims is combined before it is shuffled.
    The per-code result is a table of one row a code, which its size says whether
    to broadcast, so that the claims need not be dealt out by code.
    ``approx=True`` uses ``percentile_approx`` instead (bounded memory per group,
    1/10000 rank error)."""
    if approx:
        med = df.groupBy(by).agg(F.percentile_approx(col, 0.5, 10000).alias("_med"))
    else:
        med = group_median(df, [by], col, "_med")
    med = checked_broadcast(materialize(med.select(F.col(by).alias("_by"), "_med")))
    j = df.join(med, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")
    imputed = F.when(F.col("_med").isNotNull(), F.round(F.greatest(F.col("_med"), F.col(floor)), k))
    return j.withColumn(col, F.coalesce(F.round(F.col(col), k), imputed).cast(MONEY)).drop("_med")


def _patient_dates(raw: DataFrame, cfg: ClaimsConfig) -> tuple[dict, Column]:
    dates = {c: parse_date(c) for c in (cfg.date_of_birth, cfg.enrollment_date)}
    bad = F.lit(False)
    for c, parsed in dates.items():
        bad = bad | (F.col(c).isNotNull() & parsed.isNull())
    return dates, bad


def clean_patients(raw: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """gender coded to Female/Male, missing state -> Unknown, ISO dates; rows
    with a date that does not parse are left out (``patient_rejects``)."""
    dates, bad = _patient_dates(raw, cfg)
    return raw.where(~bad).withColumns(
        {
            cfg.gender: normalise_code(cfg.gender, GENDER_MAP),
            cfg.state: F.coalesce(F.col(cfg.state), F.lit(UNKNOWN_STATE)),
            **dates,
        }
    )


def patient_rejects(raw: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """Raw patients with a date that does not parse."""
    _, bad = _patient_dates(raw, cfg)
    return raw.where(bad).withColumn("reject_reason", F.lit("unparseable date"))


def clean_providers(raw: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """Strip and title-case the specialty."""
    return raw.withColumn(cfg.specialty, title_case(cfg.specialty))


def _date_cols(cfg: ClaimsConfig) -> list[str]:
    return [cfg.service_date, cfg.submission_date, cfg.processed_date]


def _parsed(df: DataFrame, cfg: ClaimsConfig) -> tuple[dict, Column, Column]:
    """(typed dates and amounts, bad date, bad amount): bad is a non-null text
    that is neither accepted date spelling, or no number. The two flags are sums, not
    short-circuit conditions, so each text is parsed once for its value and its flag."""
    cols, bad_date, bad_money = {}, F.lit(0), F.lit(0)

    def lost(c):
        return F.col(c).isNotNull().cast("int") * cols[c].isNull().cast("int")

    for c in _date_cols(cfg):
        cols[c] = parse_mixed_dates(c)
        bad_date = bad_date + lost(c)
    for c in (cfg.billed, cfg.allowed, cfg.paid):
        if df.schema[c].dataType.typeName() == "string":
            cols[c] = strip_ws(c).try_cast(MONEY)
            bad_money = bad_money + lost(c)
    return cols, bad_date > 0, bad_money > 0


HASH, BAD_DATE, BAD_MONEY = "_hash", "_bad_date", "_bad_money"


def parsed_claims(raw: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """Raw claims as a table, with their parsed values, what is wrong with them and a hash of
    each raw row, for ``typed_claims`` and ``claim_rejects`` to read where both are asked for."""
    cols, bad_date, bad_money = _parsed(raw, cfg)
    cols[cfg.status] = title_case(cfg.status)
    extra = {BAD_DATE: bad_date, BAD_MONEY: bad_money, HASH: row_hash(raw.columns)}
    return materialize(raw.withColumns({f"_typed_{c}": v for c, v in cols.items()} | extra))


def typed_claims(raw: DataFrame, cfg: ClaimsConfig = DEFAULT, after_normalise: bool = False, parsed: DataFrame | None = None) -> DataFrame:
    """Claims that parse, each once, with typed columns, a normal status, billed
    amounts of the right sign and a flag on the missing ones; nothing is filled yet,
    so keys and flags can be counted without the medians. By default exact
    duplicates are dropped before normalising (as the reference does), so a copy
    written with another date spelling survives; ``after_normalise`` drops
    duplicates of the normalised rows instead. ``parsed``: ``parsed_claims`` of ``raw``."""
    if parsed is not None and not after_normalise:
        d = drop_exact_duplicates(parsed, raw.columns, hashed=HASH).where(~(F.col(BAD_DATE) | F.col(BAD_MONEY)))
        return _signed(d.select(*[F.col(t if (t := f"_typed_{c}") in d.columns else c).alias(c) for c in raw.columns]), cfg)
    cols, bad_date, bad_money = _parsed(raw, cfg)
    cols[cfg.status] = title_case(cfg.status)
    typed = {c: f"_typed_{c}" for c in cols}
    d = raw.withColumns({n: cols[c] for c, n in typed.items()} | {"_rejected": bad_date.cast("int") + bad_money.cast("int") > 0})
    # parsed in the same pass that writes the rows to tell apart, so later passes read values
    same = [typed.get(c, c) for c in raw.columns] if after_normalise else raw.columns
    d = drop_exact_duplicates(d, same).where(~F.col("_rejected"))
    return _signed(d.select(*[F.col(typed.get(c, c)).alias(c) for c in raw.columns]), cfg)


def _signed(d: DataFrame, cfg: ClaimsConfig) -> DataFrame:
    return flag_missing(fix_negative(d, cfg.billed), cfg.billed, cfg.billed_imputed)


def clean_claims(raw: DataFrame, cfg: ClaimsConfig = DEFAULT, approx_median: bool = False,
                 after_normalise: bool = False, parsed: DataFrame | None = None) -> DataFrame:
    """Clean claims: ``typed_claims`` with missing billed amounts and blank reasons
    filled (see ``claim_rejects`` for the rows left out). The medians and the rows to
    fill both read the table that the removal of duplicates leaves."""
    return fill_claims(typed_claims(raw, cfg, after_normalise, parsed), cfg, approx_median)


def fill_claims(typed: DataFrame, cfg: ClaimsConfig = DEFAULT, approx_median: bool = False) -> DataFrame:
    """The filling of ``clean_claims``, over what ``typed_claims`` returns."""
    d = impute_with_floor(typed, cfg.billed, cfg.cpt_code, cfg.allowed, approx=approx_median)
    return d.withColumn(cfg.reason, F.coalesce(F.col(cfg.reason), F.lit(cfg.no_reason)))


def claim_rejects(raw: DataFrame, cfg: ClaimsConfig = DEFAULT, parsed: DataFrame | None = None) -> DataFrame:
    """Distinct raw rows with a date of no accepted spelling or an amount
    that is no number, and which it is. Only these are de-duplicated. ``parsed``:
    ``parsed_claims`` of ``raw``."""
    if parsed is None:
        rows, (_, bad_date, bad_money) = raw, _parsed(raw, cfg)
    else:
        rows, bad_date, bad_money = parsed, F.col(BAD_DATE), F.col(BAD_MONEY)
    reason = F.when(bad_date, F.lit("unparseable date")).otherwise(F.lit("unparseable amount"))
    found = rows.where(bad_date | bad_money).withColumn("reject_reason", reason)  # the reason follows from the row
    return found.select(*raw.columns, "reject_reason").dropDuplicates()
