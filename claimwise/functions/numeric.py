"""Ratios, shares and rounding that give the same digits as a SQL engine.

* Division never raises: ANSI mode makes ``/`` fail on zero, so ratios use
  ``try_divide`` (zero denominator -> null, like SQL NULL / DAX BLANK).
* Ratios are computed in double as ``(100 * a) / b``; rounding goes through
  ``decimal(38,6)`` so half-up rounding is done on a decimal, not on a
  binary fraction (1.005 rounds to 1.01 on both engines).
* Money stays ``decimal(18,2)`` until the outermost projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUND_DEC = "decimal(38,6)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_up(c, k: int = 1) -> Column:
    """Round a double half away from zero at ``k`` digits, return double."""
    return F.round(_c(c).cast(ROUND_DEC), k).cast("double")


def money(c, k: int = 0) -> Column:
    """Round a decimal amount (sum of money) and return double."""
    return F.round(_c(c), k).cast("double")


def ratio(num, den) -> Column:
    """num / den in double; null when den is 0 or null."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den, k: int | None = 1) -> Column:
    """100 * num / den, rounded to ``k`` digits (``None`` = unrounded)."""
    v = F.try_divide(_c(num).cast("double") * F.lit(100.0), _c(den).cast("double"))
    return v if k is None else round_half_up(v, k)


def safe_avg(c, pred: Column | None = None) -> Column:
    """Mean of non-null values (optionally only where ``pred``) as
    sum/count in double: identical digits on any engine."""
    x = _c(c) if pred is None else F.when(pred, _c(c))
    return F.try_divide(F.sum(x).cast("double"), F.count(x).cast("double"))


def count_if(pred: Column) -> Column:
    """Number of rows where ``pred`` is true (null counts as false). Returns
    0, not null, on an empty group."""
    return F.coalesce(F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def sum_if(c, pred: Column) -> Column:
    """SUM(CASE WHEN pred THEN c END): null when no row qualifies."""
    return F.sum(F.when(pred, _c(c)))


def agg_if(fn: str, c, *predicates: Column) -> Column:
    """Spreadsheet COUNTIFS / SUMIFS / AVERAGEIFS: aggregate ``c`` over the
    rows where every predicate holds. ``fn`` is count|sum|avg|min|max."""
    pred = F.lit(True)
    for p in predicates:
        pred = pred & F.coalesce(p, F.lit(False))
    if fn == "count":
        return count_if(pred)
    if fn == "sum":
        return F.coalesce(F.sum(F.when(pred, _c(c))), F.lit(0))
    if fn == "avg":
        return safe_avg(c, pred)
    if fn in ("min", "max"):
        return getattr(F, fn)(F.when(pred, _c(c)))
    raise ValueError(f"unknown aggregate {fn}")
