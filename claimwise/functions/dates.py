"""Date parsing and calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimwise.functions.text import strip_ws

ISO = "yyyy-MM-dd"
US = "MM/dd/yyyy"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = ISO) -> Column:
    """Text -> date; a value in another format gives null (never raises)."""
    return F.try_to_date(_c(c), fmt)


def parse_mixed_dates(c, formats=(ISO, US)) -> Column:
    """Per-value detection of several date spellings: the first format that
    parses wins. A non-null text that matches none yields null (the caller
    routes such rows to the reject table). Only exact shapes are accepted
    (``05-03-2024`` is rejected, not guessed). A text of the ISO or US shape is cast as
    ISO text, which costs a fraction of a formatter; there is no year 0000."""
    col = strip_ws(_c(c))
    shapes = {ISO: (r"^(?!0000)\d{4}-\d{2}-\d{2}$", col),
              US: (r"^\d{2}/\d{2}/(?!0000)\d{4}$", F.concat_ws("-", F.substring(col, 7, 4), F.substring(col, 1, 2), F.substring(col, 4, 2)))}
    out = None
    for fmt in formats:
        if fmt in shapes:
            shape, iso = shapes[fmt]
            parsed = F.when((F.length(col) == 10) & col.rlike(shape), iso.try_cast("date"))
        else:
            parsed = F.try_to_date(col, fmt)
        out = parsed if out is None else F.coalesce(out, parsed)
    return out


def month_label(c) -> Column:
    """``yyyy-MM`` label of a date."""
    return F.date_format(_c(c), "yyyy-MM")


def month_key(c) -> Column:
    """Integer yyyymm."""
    return (F.year(_c(c)) * 100 + F.month(_c(c))).cast("int")


def year_of(c) -> Column:
    return F.year(_c(c)).cast("int")


def days_between(later, earlier) -> Column:
    """later - earlier in days; null if either is null."""
    return F.datediff(_c(later), _c(earlier)).cast("int")


def age_at(service, birth) -> Column:
    """Completed years = floor(days / 365.25)."""
    return F.floor(F.datediff(_c(service), _c(birth)) / F.lit(365.25)).cast("int")
