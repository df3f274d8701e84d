"""Column-level helpers: every function returns a ``Column`` built from
built-in Spark SQL expressions (no Python UDFs)."""

from claimwise.functions.numeric import (  # noqa: F401
    agg_if,
    count_if,
    money,
    pct,
    ratio,
    round_half_up,
    safe_avg,
    sum_if,
)
from claimwise.functions.dates import (  # noqa: F401
    age_at,
    days_between,
    month_key,
    month_label,
    parse_date,
    parse_mixed_dates,
    year_of,
)
from claimwise.functions.text import normalise_code, strip_ws, title_case  # noqa: F401
from claimwise.functions.bands import age_band, lag_band  # noqa: F401
