"""Removal of exact duplicates in two phases.

``dropDuplicates`` over all columns sends every row through a shuffle, although
hardly any row has a copy. Here a 64-bit hash of each row is counted first (eight
bytes a row, combined in each task); rows whose hash occurs once cannot have a
copy and stay where they are. Only the rows of repeated hashes meet in a shuffle,
and there the rows themselves are compared: the hash filters, it never decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwise.session import materialize
from claimwise.sources.joins import estimated_bytes, max_bytes


def row_hash(columns: list[str]) -> Column:
    """Equal rows have equal hashes (null equals null). Different rows may too."""
    return F.xxhash64(*columns)


def drop_exact_duplicates(df: DataFrame, columns: list[str] | None = None, hash_of: Callable[[list[str]], Column] = row_hash,
                          stored: bool = False, hashed: str | None = None) -> DataFrame:
    """One row of each group of rows that agree in ``columns`` (default: all).

    The input is read three times (hashes, single rows, rows of repeated hashes), so
    it is written once as a table unless it is one already (``stored``; ``hashed``: a table
    whose column of that name, which is left out, has the hashes). Repeated
    hashes are broadcast if their table is within the broadcast bound. Beyond it, so
    many rows have copies that all of them are compared in one shuffle, as
    ``dropDuplicates`` does."""
    columns = list(columns or df.columns)
    columns = [c for c in columns if c != hashed]
    name = hashed or "_row_hash"
    while name in df.columns and not hashed:
        name += "_"
    rows = df
    if not hashed:
        rows = df.withColumn(name, hash_of(columns))
        rows = rows if stored else materialize(rows)
    repeated = materialize(rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name))
    if estimated_bytes(repeated) > max_bytes(repeated):
        return rows.dropDuplicates(columns).drop(name)
    known = F.broadcast(repeated)
    single = rows.join(known, name, "left_anti")
    several = rows.join(known, name, "left_semi").dropDuplicates(columns)
    return single.unionByName(several).drop(name)
