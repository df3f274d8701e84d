"""Members: spend concentration (q10) and age bands (q13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import age_band, count_if, money, pct, round_half_up
from claimwise.functions.numeric import safe_avg
from claimwise.operators.kpis import decided, denied, paid_status
from claimwise.operators.ranking import ntile_groups
from claimwise.session import materialize

# Labels of the reference's member groups.
GROUP_LABELS = ("Top 1%", "Top 2-5%", "Top 6-20%", "Bottom 80%")


def spend_concentration(w: DataFrame, cfg: ClaimsConfig = DEFAULT, buckets: int = 100,
                        cuts: tuple = (1, 5, 20), labels: tuple = GROUP_LABELS) -> DataFrame:
    """q10: paid per member, NTILE(buckets) by paid desc (ties by member id),
    grouped into top 1 / 2-5 / 6-20 / rest with member counts, paid and
    share of all paid. Members are not sorted: counts per range of paid find the
    three cuts, and only members near them are ordered (``ranking.ntile_groups``).
    The share's denominator is a window over the <= 4 groups."""
    spend = materialize(w.groupBy(cfg.patient_id).agg(F.sum(cfg.paid).alias("_paid")))  # a row a member, read by each step
    b = ntile_groups(spend, "_paid", cfg.patient_id, buckets, cuts, "_first")
    g = b.groupBy("_first").agg(F.count(F.lit(1)).alias("members"), F.sum("_paid").alias("_paid"))
    g = g.withColumn("member_group", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("_first") + 1))
    return g.select(
        "member_group",
        "members",
        money("_paid").alias("paid"),
        pct("_paid", F.sum("_paid").over(Window.partitionBy())).alias("share_of_paid_pct"),
        "_first",
    ).orderBy("_first").drop("_first")


def age_groups(w: DataFrame, cfg: ClaimsConfig = DEFAULT, edges: tuple = (18, 35, 50, 65)) -> DataFrame:
    """q13: claims of matched patients by age band at service: count,
    denial % and mean paid over Paid claims. Age = floor(days / 365.25)."""
    d = w.where(F.col("age_at_service").isNotNull())
    g = d.groupBy(age_band(F.col("age_at_service"), edges).alias("age_group")).agg(
        F.count(F.lit(1)).alias("claims"),
        count_if(denied(cfg)).alias("_denied"),
        count_if(decided(cfg)).alias("_decided"),
        safe_avg(cfg.paid, paid_status(cfg)).alias("_avg_paid"),
    )
    return g.select(
        "age_group", "claims", pct("_denied", "_decided").alias("denial_rate_pct"),
        round_half_up("_avg_paid", 0).alias("avg_paid"),
    ).orderBy("age_group")
