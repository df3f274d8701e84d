"""Headline figures and plan x network rates (q01, q05, e01, e06, x03, x05).

All of them are one ``groupBy().agg`` (or a global ``agg``): Spark computes
partial aggregates in every task and shuffles only one row per group and
task, so a hot group costs no more than a cold one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, money, pct, ratio, round_half_up, safe_avg, sum_if


def denied(cfg: ClaimsConfig):
    return F.col(cfg.status) == F.lit(cfg.status_denied)


def decided(cfg: ClaimsConfig):
    return F.col(cfg.status) != F.lit(cfg.status_pending)


def paid_status(cfg: ClaimsConfig):
    return F.col(cfg.status) == F.lit(cfg.status_paid)


def headline_kpis(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q01: rows, distinct patients, billed, paid, paid/billed %, denial %,
    billed of denied claims."""
    a = w.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.countDistinct(cfg.patient_id).alias("unique_patients"),
        F.sum(cfg.billed).alias("_billed"),
        F.sum(cfg.paid).alias("_paid"),
        count_if(denied(cfg)).alias("_denied"),
        count_if(decided(cfg)).alias("_decided"),
        sum_if(cfg.billed, denied(cfg)).alias("_denied_billed"),
    )
    return a.select(
        "total_claims",
        "unique_patients",
        money("_billed").alias("total_billed"),
        money("_paid").alias("total_paid"),
        pct("_paid", "_billed").alias("paid_to_billed_pct"),
        pct("_denied", "_decided").alias("denial_rate_pct"),
        money("_denied_billed").alias("denied_billed"),
    )


def explore_kpis(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """e01: q01's figures plus the mean days to process over non-null rows
    (denial rate as a 3-dp fraction, as the notebook formats it)."""
    a = w.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.sum(cfg.billed).alias("_billed"),
        F.sum(cfg.paid).alias("_paid"),
        count_if(denied(cfg)).alias("_denied"),
        count_if(decided(cfg)).alias("_decided"),
        sum_if(cfg.billed, denied(cfg)).alias("_denied_billed"),
        safe_avg("days_to_process").alias("_days"),
        F.countDistinct(cfg.patient_id).alias("unique_patients"),
    )
    return a.select(
        "total_claims",
        money("_billed").alias("total_billed"),
        money("_paid").alias("total_paid"),
        round_half_up(ratio("_denied", "_decided"), 3).alias("denial_rate"),
        money("_denied_billed").alias("denied_billed"),
        round_half_up("_days", 1).alias("avg_days_to_process"),
        "unique_patients",
    )


def plan_network(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q05: decided claims that match both dimensions; count and denial %
    per (plan_type, network_status)."""
    d = w.where(decided(cfg) & F.col(cfg.plan_type).isNotNull() & F.col(cfg.network).isNotNull())
    return (
        d.groupBy(cfg.plan_type, cfg.network)
        .agg(F.count(F.lit(1)).alias("decided_claims"), count_if(denied(cfg)).alias("_denied"))
        .select(cfg.plan_type, cfg.network, "decided_claims", pct("_denied", "decided_claims").alias("denial_rate_pct"))
        .orderBy(cfg.plan_type, cfg.network)
    )


def plan_network_matrix(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """e06: plan x network pivot of the denial rate (fraction, 3 dp), rows in
    ``cfg.plan_order``; a missing combination is null."""
    d = w.where(decided(cfg))
    g = d.groupBy(cfg.plan_type).agg(
        *[
            round_half_up(
                ratio(count_if(denied(cfg) & (F.col(cfg.network) == F.lit(net))),
                      count_if(F.col(cfg.network) == F.lit(net))), 3
            ).alias(_slug(net))
            for net in (cfg.in_network, cfg.out_network)
        ]
    )
    order = F.array_position(F.array(*[F.lit(p) for p in cfg.plan_order]), F.col(cfg.plan_type))
    return g.where(F.col(cfg.plan_type).isin(list(cfg.plan_order))).orderBy(order).select(
        cfg.plan_type, *[_slug(n) for n in (cfg.in_network, cfg.out_network)]
    )


def plan_network_gap(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """x03: rate per plan for each network and the gap in points (out - in);
    rates are fractions (4 dp), gap 1 dp. A zero denominator gives null."""
    d = w.where(decided(cfg))
    rates = {}
    g = d.groupBy(cfg.plan_type).agg(
        *[count_if(denied(cfg) & (F.col(cfg.network) == F.lit(n))).alias(f"_d{i}") for i, n in enumerate((cfg.in_network, cfg.out_network))],
        *[count_if(F.col(cfg.network) == F.lit(n)).alias(f"_n{i}") for i, n in enumerate((cfg.in_network, cfg.out_network))],
    )
    for i in (0, 1):
        rates[i] = ratio(f"_d{i}", f"_n{i}")
    return g.select(
        cfg.plan_type,
        round_half_up(rates[0], 4).alias("in_network_rate"),
        round_half_up(rates[1], 4).alias("out_network_rate"),
        round_half_up((rates[1] - rates[0]) * F.lit(100.0), 1).alias("gap_pts"),
    ).orderBy(cfg.plan_type)


def sheet_kpis(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """x05: the dashboard's six headline numbers."""
    a = w.agg(
        F.count(cfg.claim_id).alias("total_claims"),
        F.sum(cfg.billed).alias("_billed"),
        F.sum(cfg.paid).alias("_paid"),
        count_if(denied(cfg)).alias("_denied"),
        count_if(decided(cfg)).alias("_decided"),
        sum_if(cfg.billed, denied(cfg)).alias("_denied_billed"),
        safe_avg("days_to_process").alias("_days"),
    )
    return a.select(
        "total_claims",
        money("_billed", 2).alias("total_billed"),
        money("_paid", 2).alias("total_paid"),
        round_half_up(ratio("_denied", "_decided"), 4).alias("denial_rate"),
        money("_denied_billed", 2).alias("denied_billed"),
        round_half_up("_days", 2).alias("avg_days_to_process"),
    )


def _slug(v: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in v).strip("_").lower()
