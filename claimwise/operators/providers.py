"""Provider scorecard and peer comparison (q06, q07, q08, q09, e07, e08, x04).

The fact is reduced to one row per provider before anything else (partial
aggregation, so a provider holding a third of all claims is pre-combined in
every task). Peer rates are a second aggregate over those provider rows by
(claim_type, network) - a handful of rows - joined back, instead of a
window partitioned by two low-cardinality columns, which would put all
providers of a peer group into one task. The volume filter is applied only
after the peer rates exist, so small providers still count in their peers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if, money, pct, ratio, round_half_up, safe_avg, sum_if
from claimwise.operators.kpis import decided, denied, paid_status
from claimwise.session import materialize


def _provider_aggs(cfg: ClaimsConfig, scope=None) -> list:
    """Per-provider figures; ``scope`` restricts every figure to the rows
    where it holds (e.g. decided claims only)."""
    def w(col):
        return F.col(col) if scope is None else F.when(scope, F.col(col))

    def s(pred):
        return pred if scope is None else scope & pred

    return [
        count_if(s(decided(cfg))).alias("decided_claims"),
        count_if(s(denied(cfg))).alias("denials"),
        F.coalesce(sum_if(cfg.billed, s(denied(cfg))), F.lit(0).cast("decimal(18,2)")).alias("denied_billed"),
        F.sum(w(cfg.paid)).alias("paid"),
        (F.count(F.lit(1)) if scope is None else count_if(scope)).alias("claims"),
        F.min(w(cfg.claim_type)).alias(cfg.claim_type),
        F.min(w(cfg.network)).alias(cfg.network),
        F.min(w(cfg.specialty)).alias(cfg.specialty),
    ]


def _roll_up_providers(fine: DataFrame, cfg: ClaimsConfig) -> DataFrame:
    """Per-provider figures from a finer (provider, ...) aggregate."""
    return fine.groupBy(cfg.provider_id).agg(
        *[F.sum(c).alias(c) for c in ("decided_claims", "denials", "denied_billed", "paid", "claims")],
        *[F.min(c).alias(c) for c in (cfg.claim_type, cfg.network, cfg.specialty)],
    )


def provider_stats(w: DataFrame | None, providers: DataFrame, cfg: ClaimsConfig = DEFAULT,
                   per_provider: DataFrame | None = None) -> DataFrame:
    """One row per provider with claims: decided, denials, denied billed,
    paid (all statuses), claims, type/network/specialty, name, rate, peer
    rate (sum of denials / sum of decided over the provider's claim type and
    network) and excess in points. Rates are unrounded doubles.
    ``per_provider`` supplies the per-provider figures already aggregated."""
    g = per_provider if per_provider is not None else w.groupBy(cfg.provider_id).agg(*_provider_aggs(cfg))
    names = providers.select(F.col(cfg.provider_id).alias("_pk"), cfg.provider_name)
    g = g.join(names, g[cfg.provider_id] == names["_pk"], "left").drop("_pk")
    # one row per provider, read by the peer roll-up and by the result:
    # written once so the fact is aggregated in a single pass
    g = materialize(g)
    peers = g.groupBy(cfg.claim_type, cfg.network).agg(
        F.sum("denials").alias("_peer_denials"), F.sum("decided_claims").alias("_peer_decided")
    )
    peers = peers.select(
        F.col(cfg.claim_type).alias("_t"), F.col(cfg.network).alias("_n"),
        ratio("_peer_denials", "_peer_decided").alias("peer_rate"),
    )
    cond = g[cfg.claim_type].eqNullSafe(peers["_t"]) & g[cfg.network].eqNullSafe(peers["_n"])
    out = g.join(peers, cond, "left").drop("_t", "_n")
    rate = ratio("denials", "decided_claims")
    return out.withColumn("denial_rate", rate).withColumn(
        "excess_pts", F.when(rate.isNotNull(), (rate - F.col("peer_rate")) * F.lit(100.0))
    )


def provider_outliers(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT,
                      min_decided: int | None = None, k: int | None = None,
                      stats: DataFrame | None = None) -> DataFrame:
    """q06: providers with at least ``min_decided`` decided claims, ordered
    by rounded excess over peers (ties by provider id), top ``k``.
    ``stats``: ``provider_stats`` over decided claims, if already built."""
    min_decided = cfg.min_decided if min_decided is None else min_decided
    k = k or cfg.top_k
    s = stats if stats is not None else provider_stats(w.where(decided(cfg)), providers, cfg)
    s = s.where(F.col("decided_claims") >= F.lit(min_decided)).select(
        cfg.provider_id,
        cfg.provider_name,
        cfg.specialty,
        cfg.network,
        "decided_claims",
        round_half_up(F.col("denial_rate") * F.lit(100.0), 1).alias("denial_rate_pct"),
        round_half_up(F.col("peer_rate") * F.lit(100.0), 1).alias("peer_rate_pct"),
        round_half_up("excess_pts", 1).alias("excess_pts"),
    )
    return s.orderBy(F.col("excess_pts").desc_nulls_last(), F.col(cfg.provider_id)).limit(k)


def top_reasons_flagged(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT,
                        names: DataFrame | list | None = None, k: int = 2) -> DataFrame:
    """q07: the ``k`` most frequent denial reasons at the named providers
    (ROW_NUMBER; ties broken by reason). ``names`` is a list, a one-column
    DataFrame of names, or None = the 3 worst providers of ``provider_outliers``."""
    if names is None and cfg.flagged_providers:
        names = list(cfg.flagged_providers)
    per_reason = None
    if names is None:
        # one pass over the fact at (provider, reason): the outlier ranking
        # (decided claims only) and the reason counts both roll up from it
        per_reason = materialize(
            w.groupBy(cfg.provider_id, cfg.reason).agg(*_provider_aggs(cfg, scope=decided(cfg)))
        )
        per_provider = _roll_up_providers(per_reason, cfg).where(F.col("decided_claims") > 0)
        stats = provider_stats(None, providers, cfg, per_provider=per_provider)
        names_df = provider_outliers(w, providers, cfg, k=3, stats=stats).select(cfg.provider_name)
    elif isinstance(names, DataFrame):
        names_df = names.select(cfg.provider_name)
    else:
        names_df = w.sparkSession.createDataFrame([(n,) for n in names], f"{cfg.provider_name} string")
    # the provider ids behind the names; Spark/AQE broadcast it when it is small
    flagged = providers.join(names_df.distinct(), cfg.provider_name, "left_semi").select(
        F.col(cfg.provider_id).alias("_pk"), cfg.provider_name
    )
    if per_reason is not None:
        d = per_reason.where(F.col("denials") > 0).join(flagged, F.col(cfg.provider_id) == F.col("_pk"))
        g = d.groupBy(cfg.provider_name, cfg.reason).agg(F.sum("denials").alias("denials"))
    else:
        d = w.where(denied(cfg)).join(flagged, F.col(cfg.provider_id) == F.col("_pk"))
        g = d.groupBy(cfg.provider_name, cfg.reason).agg(F.count(F.lit(1)).alias("denials"))
    rn = F.row_number().over(
        Window.partitionBy(cfg.provider_name).orderBy(F.col("denials").desc(), F.col(cfg.reason))
    )
    return g.withColumn("_rn", rn).where(F.col("_rn") <= k).drop("_rn").orderBy(
        cfg.provider_name, F.col("denials").desc(), cfg.reason
    )


def top_per_specialty(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT, k: int = 3) -> DataFrame:
    """q08: denied billed per (specialty, provider name), DENSE_RANK within
    the specialty on the unrounded sum, keep rank <= k (ties may add rows).
    The rank filter lets Spark insert a partial per-partition group limit
    before the shuffle."""
    per_provider = w.where(denied(cfg)).groupBy(cfg.provider_id).agg(F.sum(cfg.billed).alias("_billed"))
    dims = providers.select(F.col(cfg.provider_id).alias("_pk"), cfg.specialty, cfg.provider_name)
    g = (
        per_provider.join(dims, per_provider[cfg.provider_id] == dims["_pk"])
        .groupBy(cfg.specialty, cfg.provider_name)
        .agg(F.sum("_billed").alias("_billed"))
    )
    rnk = F.dense_rank().over(Window.partitionBy(cfg.specialty).orderBy(F.col("_billed").desc()))
    return (
        g.withColumn("rnk", rnk)
        .where(F.col("rnk") <= k)
        .select(cfg.specialty, F.col("rnk").cast("bigint").alias("rnk"), cfg.provider_name,
                money("_billed").alias("denied_billed"))
        .orderBy(cfg.specialty, "rnk", cfg.provider_name)
    )


def cost_by_specialty(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """q09: claims and paid per specialty with shares of the totals and the
    average paid over Paid claims only. The fact is reduced per provider
    first, then joined to the provider dimension."""
    per_provider = w.groupBy(cfg.provider_id).agg(
        F.count(F.lit(1)).alias("_claims"),
        F.sum(cfg.paid).alias("_paid"),
        sum_if(cfg.paid, paid_status(cfg)).alias("_paid_on_paid"),
        F.count(F.when(paid_status(cfg) & F.col(cfg.paid).isNotNull(), F.lit(1))).alias("_n_paid"),
    )
    dims = providers.select(F.col(cfg.provider_id).alias("_pk"), cfg.specialty)
    g = (
        per_provider.join(dims, per_provider[cfg.provider_id] == dims["_pk"])
        .groupBy(cfg.specialty)
        .agg(
            F.sum("_claims").alias("claims"),
            F.sum("_paid").alias("_paid"),
            F.sum("_paid_on_paid").alias("_pp"),
            F.sum("_n_paid").alias("_np"),
        )
    )
    allw = Window.partitionBy()
    return g.select(
        cfg.specialty,
        F.col("claims").cast("bigint").alias("claims"),
        pct("claims", F.sum("claims").over(allw)).alias("share_of_claims_pct"),
        money("_paid").alias("paid"),
        pct("_paid", F.sum("_paid").over(allw)).alias("share_of_paid_pct"),
        round_half_up(ratio("_pp", "_np"), 0).alias("avg_paid_per_paid_claim"),
    ).orderBy(F.col("paid").desc(), cfg.specialty)


def explore_scorecard(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT,
                      min_decided: int | None = None, k: int | None = None, flag: float = 0.10) -> DataFrame:
    """e07: decided claims; per provider count, rate, denied billed;
    expected rate = peer rate of all decided claims of the same type and
    network; excess as a fraction; top ``k`` by excess; flag > ``flag``."""
    min_decided = cfg.min_decided if min_decided is None else min_decided
    k = k or cfg.top_k
    s = provider_stats(w.where(decided(cfg)), providers, cfg)
    excess = F.col("denial_rate") - F.col("peer_rate")
    s = s.where(F.col("decided_claims") >= F.lit(min_decided)).select(
        cfg.provider_id,
        cfg.provider_name,
        cfg.specialty,
        cfg.network,
        F.col("decided_claims").alias("claims"),
        round_half_up("denial_rate", 4).alias("denial_rate"),
        round_half_up("peer_rate", 4).alias("expected_rate"),
        round_half_up(excess, 4).alias("excess"),
        money("denied_billed", 2).alias("denied_billed"),
        (excess > F.lit(flag)).alias("is_flagged"),
        excess.alias("_x"),
    )
    return s.orderBy(F.col("_x").desc_nulls_last(), cfg.provider_id).limit(k).drop("_x")


def paid_by_specialty(w: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """e08: paid, claims and mean paid over all claims per specialty, share
    of paid as a 3-dp fraction."""
    g = w.groupBy(cfg.specialty).agg(
        F.sum(cfg.paid).alias("_paid"), F.count(cfg.claim_id).alias("claims"), safe_avg(cfg.paid).alias("_avg")
    )
    return g.select(
        cfg.specialty,
        money("_paid", 2).alias("paid"),
        "claims",
        round_half_up("_avg", 2).alias("avg_paid"),
        round_half_up(ratio("_paid", F.sum("_paid").over(Window.partitionBy())), 3).alias("share_of_paid"),
    ).orderBy(F.col("paid").desc(), cfg.specialty)


def sheet_scorecard(w: DataFrame, providers: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """x04: every provider with decided claims (no volume floor): decided,
    denied, rate (0 if none), peer rate, excess points, denied billed and
    paid over all statuses; worst first."""
    s = provider_stats(w, providers, cfg).where(F.col("decided_claims") > 0)
    rate = F.coalesce(F.col("denial_rate"), F.lit(0.0))
    return s.select(
        cfg.provider_id,
        cfg.provider_name,
        cfg.specialty,
        cfg.network,
        cfg.claim_type,
        "decided_claims",
        F.col("denials").alias("denied_claims"),
        round_half_up(rate, 4).alias("denial_rate"),
        round_half_up("peer_rate", 4).alias("peer_rate"),
        round_half_up((rate - F.col("peer_rate")) * F.lit(100.0), 2).alias("excess_pts"),
        money("denied_billed", 2).alias("denied_billed"),
        money("paid", 2).alias("paid"),
        ((rate - F.col("peer_rate")) * F.lit(100.0)).alias("_x"),
    ).orderBy(F.col("_x").desc_nulls_last(), cfg.provider_id).drop("_x")
