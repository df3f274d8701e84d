"""String normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The white space that a pattern's \\s stands for.
WHITE = " \t\n\x0b\f\r"


def strip_ws(c) -> Column:
    """Remove leading/trailing whitespace including tabs and newlines
    (Spark ``trim`` removes spaces only)."""
    return F.btrim(_c(c), F.lit(WHITE))


def title_case(c) -> Column:
    """Strip, then capitalise the first letter of each word and lower-case
    the rest: `` EMERGENCY MEDICINE `` -> ``Emergency Medicine``."""
    return F.initcap(F.lower(strip_ws(c)))


def normalise_code(c, mapping: dict) -> Column:
    """Strip, upper-case, keep the first character and map it through
    ``mapping`` (e.g. {"F": "Female", "M": "Male"}); unmapped -> null."""
    key = F.substring(F.upper(strip_ws(c)), 1, 1)
    out = None
    for k, v in mapping.items():
        out = (F.when(key == F.lit(k), F.lit(v))) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out
