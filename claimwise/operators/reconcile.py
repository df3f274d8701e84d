"""Do different routes to a figure agree?

The headline numbers come out of the SQL questions, the spreadsheet and the report's
cards, each with its own rounding. ``reconcile`` sets named figures of several routes
side by side and says where they differ by more than their roundings allow.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwise.functions import round_half_up

SLACK = 1e-9  # of binary fractions


@dataclass(frozen=True)
class Figure:
    """Where a route has a figure: a column of a one-row frame, what to multiply it by,
    and to how many digits (after multiplying) the route has rounded it."""

    route: str
    column: str
    digits: int = 0
    scale: float = 1.0


def reconcile(routes: Mapping[str, DataFrame], figures: Mapping[str, list[Figure]]) -> DataFrame:
    """One row per figure and route beyond its first: figure, route, value, against
    (the first route), expected, difference, equal. Two values are equal if they
    differ by no more than half a unit of each rounding; a missing value equals only
    another missing one. ``routes`` are frames of one row; each is read once."""
    one = None
    for name, df in routes.items():
        used = list(dict.fromkeys(f.column for fs in figures.values() for f in fs if f.route == name))
        row = df.select(*[F.col(c).cast("double").alias(f"{name}.{c}") for c in used])
        one = row if one is None else one.crossJoin(F.broadcast(row))  # one row each
    value = lambda f: F.col(f"`{f.route}.{f.column}`") * F.lit(f.scale)
    rows = []
    for figure, (first, *others) in figures.items():
        for f in others:
            room = 0.5 * 10.0**-first.digits + 0.5 * 10.0**-f.digits + SLACK
            gap = value(f) - value(first)
            same = (value(f).isNull() & value(first).isNull()) | F.coalesce(F.abs(gap) <= F.lit(room), F.lit(False))
            rows.append(F.struct(
                F.lit(figure).alias("figure"), F.lit(f.route).alias("route"), value(f).alias("value"), F.lit(first.route).alias("against"),
                value(first).alias("expected"), round_half_up(gap, 4).alias("difference"), same.alias("equal")))
    return one.select(F.inline(F.array(*rows)))


#: The dashboard's headline figures and where each route has them.
HEADLINE = {
    "total_claims": [Figure("sql", "total_claims"), Figure("sheet", "total_claims"), Figure("cards", "total_claims")],
    "total_paid": [Figure("sql", "total_paid"), Figure("sheet", "total_paid", 2), Figure("cards", "total_paid", 2)],
    "denial_rate_pct": [Figure("sql", "denial_rate_pct", 1), Figure("sheet", "denial_rate", 2, 100.0), Figure("cards", "denial_rate", 2, 100.0)],
    "denied_billed": [Figure("sql", "denied_billed"), Figure("sheet", "denied_billed", 2), Figure("cards", "denied_billed", 2)],
    "avg_days_to_process": [Figure("sheet", "avg_days_to_process", 2), Figure("cards", "avg_days_to_process", 2)],
    "focus_denials_compare": [Figure("reasons", "focus_compare"), Figure("sheet_reasons", "focus_compare"), Figure("cards", "prior_auth_denials_compare")],
    "focus_yoy_pct": [Figure("reasons", "focus_yoy", 1), Figure("sheet_reasons", "focus_yoy", 2, 100.0), Figure("cards", "prior_auth_yoy", 2, 100.0)],
    "worst_provider_excess_pts": [Figure("outliers", "excess_pts", 1), Figure("sheet_scorecard", "excess_pts", 2), Figure("measures", "excess_pts", 2)],
}
