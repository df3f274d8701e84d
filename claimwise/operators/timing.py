"""Submission lag and processing time (q11, q12, e09).

Day counts are small integers, so the exact median (``percentile`` keeps a
value -> count map per group, merged map-side) stays small however many
claims a status holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, days_between, lag_band, pct, round_half_up, safe_avg
from claimwise.operators.kpis import decided, denied


def submission_lag(w: DataFrame, cfg: ClaimsConfig = DEFAULT, edges: tuple = (7, 30, 90)) -> DataFrame:
    """q11: decided claims by submission-lag band: count and denial %."""
    d = w.where(decided(cfg))
    band = lag_band(days_between(cfg.submission_date, cfg.service_date), edges)
    return (
        d.groupBy(band.alias("submission_lag"))
        .agg(F.count(F.lit(1)).alias("decided_claims"), count_if(denied(cfg)).alias("_denied"))
        .select("submission_lag", "decided_claims", pct("_denied", "decided_claims").alias("denial_rate_pct"))
        .orderBy("submission_lag")
    )


def processing_time(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q12: decided claims per status: count, mean days (1 dp), exact
    interpolated median, max."""
    d = w.where(decided(cfg)).withColumn("_days", days_between(cfg.processed_date, cfg.submission_date))
    return (
        d.groupBy(cfg.status)
        .agg(
            F.count(F.lit(1)).alias("claims"),
            safe_avg("_days").alias("_avg"),
            F.median("_days").alias("median_days"),
            F.max("_days").cast("bigint").alias("max_days"),
        )
        .select(cfg.status, "claims", round_half_up("_avg", 1).alias("avg_days"), "median_days", "max_days")
        .orderBy(cfg.status)
    )


def processing_histogram(w: DataFrame, cfg: ClaimsConfig = DEFAULT, width: int = 2, upper: int = 80,
                         statuses: tuple | None = None) -> DataFrame:
    """e09: per status, density histogram of days to process with bins
    [0,w), [w,2w) ... [upper-w, upper] (last bin closed; values outside
    [0, upper] are dropped and not in the denominator), plus the median of
    all the status's days."""
    statuses = statuses or (cfg.status_paid, cfg.status_denied)
    days = days_between(cfg.processed_date, cfg.submission_date)
    d = w.where(F.col(cfg.status).isin(*statuses)).withColumn("_days", days).where(F.col("_days").isNotNull())
    # one pass: claims per status and day (a few hundred rows) give both the bins and the medians
    c = d.groupBy(cfg.status, "_days").agg(F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy(cfg.status)
    upto, total = F.sum("_n").over(every.orderBy("_days")), F.sum("_n").over(every)
    c = c.select("*", upto.alias("_upto"), total.alias("_all"))
    at = lambda place: F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_days"))).over(every)
    middle = (at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))).cast("double") / F.lit(2.0)
    c = c.withColumn("median_days", middle).where((F.col("_days") >= 0) & (F.col("_days") <= upper))
    last = upper // width - 1
    b = F.least(F.floor(F.col("_days") / width), F.lit(last)).cast("int")
    h = c.groupBy(cfg.status, "median_days", b.alias("_bin")).agg(F.sum("_n").alias("claims"))
    inside = F.sum("claims").over(every).cast("double") * F.lit(float(width))
    return h.select(
        cfg.status,
        (F.col("_bin") * width).cast("int").alias("bin_start"),
        ((F.col("_bin") + 1) * width).cast("int").alias("bin_end"),
        "claims",
        round_half_up(F.col("claims").cast("double") / inside, 6).alias("density"),
        "median_days",
    ).orderBy(cfg.status, "bin_start")
