"""Denial reasons: dollars, shares and year-over-year change (q03, q04, e04,
e05, x02). One aggregate per reason; shares are windows over that small
result (one row per reason)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, money, month_key, pct, ratio, round_half_up, year_of
from claimwise.operators.kpis import denied


def _all():
    """Window over the whole (small, already aggregated) result."""
    return Window.partitionBy()


def reason_dollars(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q03: denied claims per reason, billed, share of all denied billed."""
    g = w.where(denied(cfg)).groupBy(cfg.reason).agg(
        F.count(F.lit(1)).alias("denied_claims"), F.sum(cfg.billed).alias("_billed")
    )
    return g.select(
        cfg.reason,
        "denied_claims",
        money("_billed").alias("denied_billed"),
        pct("_billed", F.sum("_billed").over(_all())).alias("share_of_denied_pct"),
    ).orderBy(F.col("denied_billed").desc(), cfg.reason)


def reason_yoy(w: DataFrame, cfg: ClaimsConfig = DEFAULT, base_year: int | None = None,
               compare_year: int | None = None) -> DataFrame:
    """q04: denials per reason in two years and the % change (null when the
    base year has none)."""
    a = base_year or cfg.base_year
    b = compare_year or cfg.compare_year
    y = year_of(cfg.service_date)
    g = w.where(denied(cfg)).groupBy(cfg.reason).agg(
        count_if(y == F.lit(a)).alias(f"denials_{a}"), count_if(y == F.lit(b)).alias(f"denials_{b}")
    )
    return g.select(
        cfg.reason, f"denials_{a}", f"denials_{b}",
        pct(F.col(f"denials_{b}") - F.col(f"denials_{a}"), f"denials_{a}").alias("yoy_change_pct"),
    ).orderBy(F.col("yoy_change_pct").desc_nulls_last(), cfg.reason)


def reason_share(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """e04: per reason count, billed and share of denied billed as a
    fraction rounded to 3 digits."""
    g = w.where(denied(cfg)).groupBy(cfg.reason).agg(
        F.count(cfg.claim_id).alias("claims"), F.sum(cfg.billed).alias("_billed")
    )
    return g.select(
        cfg.reason, "claims", money("_billed", 2).alias("billed"),
        round_half_up(ratio("_billed", F.sum("_billed").over(_all())), 3).alias("share"),
    ).orderBy(F.col("billed").desc(), cfg.reason)


def reason_year_pivot(w: DataFrame, cfg: ClaimsConfig = DEFAULT, base_year: int | None = None,
                      compare_year: int | None = None) -> DataFrame:
    """e05: count of denials per reason x year (only the two years asked
    for; a reason absent in a year -> null) and change % = (b/a - 1)*100."""
    a = base_year or cfg.base_year
    b = compare_year or cfg.compare_year
    y = year_of(cfg.service_date)
    g = w.where(denied(cfg) & y.isin(a, b)).groupBy(cfg.reason).agg(
        F.sum(F.when(y == F.lit(a), F.lit(1))).cast("bigint").alias(f"y{a}"),
        F.sum(F.when(y == F.lit(b), F.lit(1))).cast("bigint").alias(f"y{b}"),
    )
    change = (ratio(f"y{b}", f"y{a}") - F.lit(1.0)) * F.lit(100.0)
    return g.select(cfg.reason, f"y{a}", f"y{b}", round_half_up(change, 1).alias("change_pct")).orderBy(
        F.col("change_pct").desc_nulls_last(), cfg.reason
    )


def sheet_reasons(w: DataFrame, cfg: ClaimsConfig = DEFAULT, base_range: tuple | None = None,
                  compare_range: tuple | None = None) -> DataFrame:
    """x02: per reason (ordered by denied billed): denied, billed, share,
    denials inside two month-key ranges, change (0 when the base is 0)."""
    base_range = base_range or (cfg.base_year * 100 + 1, cfg.base_year * 100 + 12)
    compare_range = compare_range or (cfg.compare_year * 100 + 1, cfg.compare_year * 100 + 12)
    mk = month_key(cfg.service_date)
    g = w.where(denied(cfg)).groupBy(cfg.reason).agg(
        F.count(F.lit(1)).alias("denied_claims"),
        F.sum(cfg.billed).alias("_billed"),
        count_if(mk.between(*base_range)).alias("denials_base"),
        count_if(mk.between(*compare_range)).alias("denials_compare"),
    )
    change = ratio("denials_compare", "denials_base") - F.lit(1.0)
    return g.select(
        cfg.reason,
        "denied_claims",
        money("_billed", 2).alias("denied_billed"),
        round_half_up(ratio("_billed", F.sum("_billed").over(_all())), 4).alias("share_of_denied"),
        "denials_base",
        "denials_compare",
        F.coalesce(round_half_up(change, 4), F.lit(0.0)).alias("yoy_change"),
    ).orderBy(F.col("denied_billed").desc(), cfg.reason)
