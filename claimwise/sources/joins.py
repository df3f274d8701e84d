"""Dimension joins with a broadcast checked by size.

Spark's static size estimate of a join is the product of its inputs, so a
small dimension built from a join chain (supplier -> nation -> region) looks
huge and the fact gets shuffled for a sort-merge join. Such a dimension has
as many rows as the table it starts from, so that table's estimated bytes
(from its files, no job) decide: within ``claimwise.broadcastMaxBytes`` the
dimension is broadcast, above it the join is left to Spark, which may still
convert it at run time. The size is read anew for every plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BYTES = 64 << 20


def max_bytes(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("claimwise.broadcastMaxBytes", str(DEFAULT_MAX_BYTES)))


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own size estimate of a plan, as EXPLAIN COST shows it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def checked_broadcast(dim: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """``broadcast(dim)`` if ``base`` (default: ``dim`` itself), the table
    whose rows it looks up values for, is within the bound; else ``dim``."""
    return F.broadcast(dim) if estimated_bytes(dim if base is None else base) <= max_bytes(dim) else dim
