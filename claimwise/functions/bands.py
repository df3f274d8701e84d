"""Banding of ages and submission lags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the reference's bands.
AGE_LABELS = ("0-17", "18-34", "35-49", "50-64", "65+")
LAG_LABELS = ("1) 0-7 days", "2) 8-30 days", "3) 31-90 days", "4) 90+ days")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def age_band(age, edges=(18, 35, 50, 65), labels=AGE_LABELS) -> Column:
    """``age < 18 -> 0-17`` ... else ``65+`` (negatives fall in the first band)."""
    a = _c(age)
    out = F.when(a < edges[0], F.lit(labels[0]))
    for e, lab in zip(edges[1:], labels[1:-1]):
        out = out.when(a < e, F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))


def lag_band(days, edges=(7, 30, 90), labels=LAG_LABELS) -> Column:
    """``days <= 7 -> 1) 0-7 days`` ... else ``4) 90+ days``."""
    d = _c(days)
    out = F.when(d <= edges[0], F.lit(labels[0]))
    for e, lab in zip(edges[1:], labels[1:-1]):
        out = out.when(d <= e, F.lit(lab))
    return out.otherwise(F.lit(labels[-1]))
