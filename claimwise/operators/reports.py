"""Report visuals and KPI cards of the dashboard (r01-r10) as measure
evaluations over the claims model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import ratio, round_half_up
from claimwise.operators.measures import evaluate

QUARTER = ["quarter_label", "quarter_sort"]

# The measures on each report page's KPI cards.
KPI_PAGES = {
    "overview": ["Total Claims", "Total Paid", "Denial Rate", "Denied Billed $", "Avg Days to Process",
                 "KPI Claims Context", "KPI Paid Context", "KPI Denial Context", "KPI Denied Context", "KPI Days Context"],
    "denials": ["Prior Auth Denials Compare", "Prior Auth YoY %", "Out-of-Network Denial Rate", "Denied Billed $",
                "KPI Prior Auth Context", "KPI Network Context", "KPI Denied Context"],
    "providers": ["Flagged Providers", "Flagged Denied $", "Flagged Coding Share", "KPI Flagged $ Context"],
}


def quarterly_rate(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r01: denial rate before the cut-off, by quarter (ascending)."""
    return evaluate(model, ["Denial Rate (complete)"], QUARTER, filters, cfg).orderBy("quarter_sort")


def reason_dollars(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r02: denied billed per reason with the focus-reason flag; reasons
    without denials vanish."""
    return evaluate(model, ["Denied Billed $", "Reason Flag"], [cfg.reason], filters, cfg).orderBy(
        F.col("denied_billed").desc(), cfg.reason)


def status_share(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r03: claims per status and share of the total (window over <= 3 rows)."""
    e = evaluate(model, ["Total Claims"], [cfg.status], filters, cfg)
    return e.withColumn(
        "share_of_total", round_half_up(ratio("total_claims", F.sum("total_claims").over(Window.partitionBy())), 4)
    ).orderBy(cfg.status)


def prior_auth_quarters(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r04: prior-authorization denials by quarter."""
    return evaluate(model, ["Prior Auth Denials"], QUARTER, filters, cfg).orderBy("quarter_sort")


def plan_network_rate(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r05: denial rate by plan type x network."""
    return evaluate(model, ["Denial Rate"], [cfg.plan_type, cfg.network], filters, cfg).orderBy(cfg.plan_type, cfg.network)


def reason_table(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r06 (and r09 with a year slicer): denials in the two fixed years
    (which ignore a year slicer), change, denied billed (which respects it)."""
    ms = ["Denials Base", "Denials Compare", "Denials YoY %", "Denied Billed $"]
    return evaluate(model, ms, [cfg.reason], filters, cfg).orderBy(F.col("denied_billed").desc_nulls_last(), cfg.reason)


def top_providers(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r07: excess points of the 10 highest-ranked providers and their flag."""
    return evaluate(model, ["Top 10 Excess (pts)", "Excess Flag"], [cfg.provider_name], filters, cfg).orderBy(
        F.col("top10_excess_pts").desc(), cfg.provider_name)


def provider_table(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r08: every provider's rate, peer rate and excess, worst first."""
    ms = ["Denial Rate", "Peer Denial Rate", "Excess Denial (pts)"]
    return evaluate(model, ms, [cfg.provider_name, cfg.specialty], filters, cfg).orderBy(
        F.col("excess_pts").desc_nulls_last(), cfg.provider_name)


def kpi_cards(model: DataFrame, page: str, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r10: one row with the KPI cards of a page."""
    return evaluate(model, KPI_PAGES[page], [], filters, cfg, drop_blank=False)


def all_cards(model: DataFrame, cfg: ClaimsConfig = DEFAULT, filters=()) -> DataFrame:
    """r10: the cards of all pages in one row, from one scan of the model."""
    cards = list(dict.fromkeys(m for page in KPI_PAGES.values() for m in page))
    return evaluate(model, cards, [], filters, cfg, drop_blank=False)
