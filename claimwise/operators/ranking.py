"""Distributed exact positions: global row index, NTILE and group medians.

A window with an ORDER BY but no PARTITION BY sends every row to one task.
Here the rows are range-partitioned on the sort key instead (Spark samples
the key to cut balanced ranges, so a hot key value cannot pile up more than
its own duplicates), sorted inside each partition, and numbered locally
with ``monotonically_increasing_id`` (partition id in the high bits, local
position in the low 33 bits). A per-partition count table - one row per
partition, so bounded by the partition count - gives each partition its
offset through a running sum. The numbered rows are checkpointed before
the two branches (counts, rows) read them, so both see the same numbering
and the numbering survives a recomputation after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwise.session import materialize

LOCAL_BITS = 33


def _partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def global_index(df: DataFrame, order: list[Column], name: str = "_idx", partitions: int | None = None,
                 total: str | None = None) -> DataFrame:
    """Add a 0-based position of each row in the total order ``order``
    (and, if ``total`` is given, the row count in that column).
    ``order`` must be a total order (end it with a unique key) so the result
    is deterministic."""
    n = _partitions(df, partitions)
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    tagged = materialize(ranged.withColumn("_mid", mid).select(
        "*",
        F.shiftright(F.col("_mid"), LOCAL_BITS).alias("_part"),
        (F.col("_mid") - F.shiftleft(F.shiftright(F.col("_mid"), LOCAL_BITS), LOCAL_BITS)).alias("_local"),
    ))
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window below runs over at most n rows
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
        F.sum("_n").over(Window.partitionBy()).alias("_total"),
    ).fillna({"_off": 0})
    out = tagged.join(F.broadcast(offsets), "_part")
    out = out.withColumn(name, (F.col("_off") + F.col("_local")).cast("bigint"))
    drop = ["_mid", "_part", "_local", "_off"]
    if total is None:
        drop.append("_total")
    elif total != "_total":
        out = out.withColumnRenamed("_total", total)
    return out.drop(*drop)


def ntile_from_index(idx: Column, total: Column, buckets: int) -> Column:
    """SQL NTILE(b) for 0-based index ``idx`` out of ``total`` rows: the
    first ``total mod b`` buckets get one extra row."""
    q = F.floor(total / F.lit(buckets))
    r = total - q * F.lit(buckets)
    big = r * (q + 1)
    first = F.floor(idx / (q + 1)) + 1
    rest = r + F.floor((idx - big) / F.when(q > 0, q)) + 1
    return F.when(idx < big, first).otherwise(rest).cast("int")


def ntile(df: DataFrame, order: list[Column], buckets: int, name: str = "bucket",
          partitions: int | None = None) -> DataFrame:
    """Exact, distributed equivalent of ``NTILE(buckets) OVER (ORDER BY order)``."""
    indexed = global_index(df, order, "_gidx", partitions, total="_total")
    return indexed.withColumn(name, ntile_from_index(F.col("_gidx"), F.col("_total"), buckets)).drop(
        "_gidx", "_total"
    )


MEDIAN_BINS = 1024


def group_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact interpolated median of ``value`` per ``keys`` (nulls skipped).

    Keys and values are written once as a narrow table. Each group's range is cut into
    MEDIAN_BINS bins; rows per bin, which a hot group combines in each task, say which
    bins hold the one or two middle positions, and only the values in those bins are
    counted and ordered. So next to nothing is shuffled, however many values differ."""
    rows = materialize(df.where(F.col(value).isNotNull()).select(*keys, value))
    spans = materialize(rows.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(F.lit(1)).alias("_all")))
    at = F.try_divide((F.col(value) - F.col("_min")).cast("double") * F.lit(float(MEDIAN_BINS)), (F.col("_max") - F.col("_min")).cast("double"))
    bin_of = F.floor(F.coalesce(at, F.lit(0.0)))
    binned = same_keys(rows, spans, keys).withColumn("_bin", bin_of)
    bins = binned.groupBy(*keys, "_all", "_bin").agg(F.count(F.lit(1)).alias("_here"))
    bins = bins.withColumn("_upto", F.sum("_here").over(Window.partitionBy(*keys).orderBy("_bin")))
    lo, hi = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)  # 0-based middle positions
    before = F.col("_upto") - F.col("_here")
    holds = ((lo >= before) & (lo < F.col("_upto"))) | ((hi >= before) & (hi < F.col("_upto")))
    middle = materialize(bins.where(holds).select(*keys, "_bin", before.alias("_before")))
    inner = same_keys(binned, middle, [*keys, "_bin"]).groupBy(*keys, "_all", "_bin", "_before", value).agg(F.count(F.lit(1)).alias("_n"))
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_bin").orderBy(value))
    inner = inner.withColumn("_end", run).withColumn("_start", F.col("_end") - F.col("_n"))
    some = inner.where(((lo >= F.col("_start")) & (lo < F.col("_end"))) | ((hi >= F.col("_start")) & (hi < F.col("_end"))))
    # decimals stay exact: avg of one or two decimals is a decimal
    return some.groupBy(*keys).agg(F.avg(F.col(value)).alias(name))


def same_keys(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe inner join on ``keys``, kept once; without keys ``few`` has
    one row."""
    if not keys:
        return rows.crossJoin(F.broadcast(few))
    other = few.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(other[f"_r_{k}"])
    return rows.join(other, on).drop(*(f"_r_{k}" for k in keys))


CUT_BINS = 1024
CUT_ROUNDS = 2
NEAR_ROWS = 100_000  # so few rows are ordered in one window; more by a distributed index


def cut_rows(df: DataFrame, value: str, key: str, positions: list[int]) -> list[tuple | None]:
    """The (value, key) of the row at each 1-based position by ``value`` descending
    (null last), then ``key``; None for position 0. ``df`` is read several times, so it
    should be a table; ``key`` is unique.

    Counts per bin of the value's range say in which bin a position falls; after
    CUT_ROUNDS only the rows in those bins are ordered, however many others there are."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        low = high = 0
    v = F.coalesce(F.col(value), F.lit(low - 1))
    rows = df.select(v.alias("v"), F.col(key).alias("k"))
    cuts = {p: (low - 1, high, 0) for p in positions if p}  # position -> range of values, rows above it
    for _ in range(CUT_ROUNDS):
        parts = []
        for p, (lo, hi, _) in cuts.items():
            at = F.try_divide((F.col("v") - F.lit(lo)).cast("double") * F.lit(float(CUT_BINS)), F.lit(float(hi - lo)))
            inside = F.col("v").between(F.lit(lo), F.lit(hi))
            parts.append(F.when(inside, F.struct(F.lit(p).alias("p"), F.floor(F.coalesce(at, F.lit(0.0))).alias("bin"))))
        binned = rows.select("v", F.explode(F.array_compact(F.array(*parts))).alias("c")) if parts else None
        counts = binned.groupBy("c.p", "c.bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect() if parts else []
        for p in cuts:  # at most CUT_BINS + 1 rows a cut
            above = cuts[p][2]
            for r in sorted((r for r in counts if r["p"] == p), key=lambda r: -r["bin"]):
                if above + r["n"] >= p:
                    cuts[p] = (r["lo"], r["hi"], above)
                    break
                above += r["n"]
    if not cuts:
        return [None for _ in positions]
    hit = [F.when(F.col("v").between(F.lit(lo), F.lit(hi)), F.lit(p)) for p, (lo, hi, _) in cuts.items()]
    near = materialize(rows.select("v", "k", F.explode(F.array_compact(F.array(*hit))).alias("p")))
    size = {r["p"]: r["n"] for r in near.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(size.values()) <= NEAR_ROWS:
        at = near.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("v"), F.asc("k"))))
        start = {p: 0 for p in cuts}
    else:
        at = global_index(near, [F.asc("p"), F.desc("v"), F.asc("k")], "i").withColumn("i", F.col("i") + 1)
        start = {p: sum(n for q, n in size.items() if q < p) for p in cuts}
    wanted = F.lit(False)
    for p, (_, _, above) in cuts.items():
        wanted = wanted | ((F.col("p") == p) & (F.col("i") == start[p] + p - above))
    found = {r["p"]: (r["v"], r["k"]) for r in at.where(wanted).collect()}  # one row a cut
    return [found.get(p) for p in positions]


def ntile_groups(df: DataFrame, value: str, key: str, buckets: int, cuts: tuple, name: str = "group") -> DataFrame:
    """Which span of ``NTILE(buckets) OVER (ORDER BY value DESC, key)`` each row is in:
    0 up to bucket ``cuts[0]``, 1 up to ``cuts[1]``, and so on. Only rows near the cuts
    are ordered; the others compare their value with the cuts' rows."""
    total = df.count()
    ends = [c * (total // buckets) + min(c, total % buckets) for c in cuts]
    rows = cut_rows(df, value, key, ends)
    low = df.agg(F.min(value)).first()[0]
    v = F.coalesce(F.col(value), F.lit((low or 0) - 1))
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        if rows[i] is not None:
            cv, ck = rows[i]
            out = F.when((v > F.lit(cv)) | ((v == F.lit(cv)) & (F.col(key) <= F.lit(ck))), F.lit(i)).otherwise(out)
    return df.withColumn(name, out)
