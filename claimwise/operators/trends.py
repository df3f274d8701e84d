"""Monthly trends (q02, e02, e03, x01).

The claims are aggregated to one row per month first (partial + final hash
aggregate); the month-over-month LAG and the year-to-date running sum are
windows over that result, whose size is bounded by the calendar span, not
by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, money, month_key, month_label, pct, ratio, round_half_up
from claimwise.operators.kpis import decided, denied


def monthly_trend(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q02: month, claims, MoM %, paid, YTD paid (unrounded sums, year
    partition), denial %."""
    m = w.groupBy(month_label(cfg.service_date).alias("month")).agg(
        F.count(F.lit(1)).alias("claims"),
        F.sum(cfg.paid).alias("_paid"),
        count_if(denied(cfg)).alias("_denied"),
        count_if(decided(cfg)).alias("_decided"),
    )
    by_month = Window.orderBy("month")
    ytd = Window.partitionBy(F.substring("month", 1, 4)).orderBy("month")
    prev = F.lag("claims").over(by_month)
    return m.select(
        "month",
        "claims",
        pct(F.col("claims") - prev, prev).alias("claims_mom_pct"),
        money("_paid").alias("paid"),
        money(F.sum("_paid").over(ytd)).alias("paid_ytd"),
        round_half_up(ratio("_denied", "_decided") * F.lit(100.0), 1).alias("denial_rate_pct"),
    ).orderBy("month")


def monthly_volume(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """e02: claims and paid per month, with the peak month flagged
    (argmax of claims; ties -> earliest month)."""
    m = w.groupBy(month_label(cfg.service_date).alias("month")).agg(
        F.count(cfg.claim_id).alias("claims"), F.sum(cfg.paid).alias("_paid")
    )
    peak = F.first("month").over(
        Window.orderBy(F.col("claims").desc(), F.col("month")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return m.select(
        "month", "claims", money("_paid", 2).alias("paid"), (F.col("month") == peak).alias("is_peak")
    ).orderBy("month")


def trend_by_type(w: DataFrame, cfg: ClaimsConfig = DEFAULT, types: list[str] | None = None) -> DataFrame:
    """e03: decided claims before the cut-off; monthly denial rate with one
    column per claim type (a month without that type -> null). ``types`` fixes
    the columns; a row of another type raises instead of being left out.
    Without ``types`` they are the distinct types of the data (one job)."""
    d = w.where(decided(cfg) & (F.col(cfg.service_date) < F.lit(cfg.cutoff_date).cast("date")))
    if types is None:
        types = sorted(r[0] for r in d.select(cfg.claim_type).distinct().collect() if r[0] is not None)
    known = F.col(cfg.claim_type).isNull() | F.col(cfg.claim_type).isin(list(types))
    d = d.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("claim type without a column: "), F.col(cfg.claim_type)))))
    aggs = [] if types else [F.count(F.lit(1)).alias("claims")]
    for t in types:
        is_t = F.col(cfg.claim_type) == F.lit(t)
        aggs.append(
            round_half_up(ratio(count_if(is_t & denied(cfg)), F.sum(F.when(is_t, F.lit(1)))), 4).alias(_slug(t))
        )
    return d.groupBy(month_label(cfg.service_date).alias("month")).agg(*aggs).orderBy("month")


def sheet_monthly(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """x01: per month key: label, claims, denied, pending, rate (0 when no
    decided claims), billed, paid and paid YTD by year."""
    m = w.groupBy(month_key(cfg.service_date).alias("month_key")).agg(
        F.count(F.lit(1)).alias("claims"),
        count_if(denied(cfg)).alias("denied"),
        count_if(F.col(cfg.status) == F.lit(cfg.status_pending)).alias("pending"),
        F.sum(cfg.billed).alias("_billed"),
        F.sum(cfg.paid).alias("_paid"),
    )
    label = F.date_format(
        F.make_date((F.col("month_key") / 100).cast("int"), (F.col("month_key") % 100).cast("int"), F.lit(1)), "MMM yyyy"
    )
    ytd = Window.partitionBy((F.col("month_key") / 100).cast("int")).orderBy("month_key")
    return m.select(
        "month_key",
        label.alias("month"),
        "claims",
        "denied",
        "pending",
        F.coalesce(round_half_up(ratio("denied", F.col("claims") - F.col("pending")), 4), F.lit(0.0)).alias("denial_rate"),
        money("_billed", 2).alias("billed"),
        money("_paid", 2).alias("paid"),
        money(F.sum("_paid").over(ytd), 2).alias("paid_ytd"),
    ).orderBy("month_key")


def _slug(v: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in v).strip("_").lower()
