"""Approximate nearest neighbours by inner product with shifted space-filling
curves: several Hilbert orderings of projected vectors.

1. Equal vectors form one class (its k + 1 smallest ids are all that a result of k
   can name), so a hot vector is one point.
2. For inner products, vectors get one more component that makes all norms equal
   (a query's is 0). Each curve projects them on random directions of its own,
   turns each coordinate into its quantile (fitted on a bounded sample), shifts it,
   and orders all points by Hilbert index; Spark sorts by range.
3. Each query meets the points within ``width`` places of its own on every curve,
   in segments of bounded size, and keeps its best by exact inner product.
4. The width is the smallest with which a sample of queries finds ``target`` of its
   true neighbours (searched exhaustively); it is measured anew on each table. On
   vectors without structure it comes near the whole table, as it must.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows with a null id. Vectors of each length are searched among themselves,
one length after another. Rows that repeat an id and vector count once; an id is
taken to have one vector (several are several candidates, and as a query its own other
vectors take places among those it finds, so it may miss some). With fewer
candidates all are returned. An empty table gives an empty result. Other columns are
ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow
from claimwise.llm.ship import ship
from claimwise.operators.ranking import global_index
from claimwise.session import materialize

CURVES, DIMS, BITS = 8, 4, 12
SEGMENT = 4096  # points compared with a query at once
SAMPLE_POINTS, SAMPLE_QUERIES = 10_000, 64  # for quantiles; for the width
TARGET = 0.97  # recall on the sample
KNOTS = 257  # quantiles kept per direction


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index (u64) of points with unsigned ``bits``-bit coordinates:
    undo the turns of each level from the top (Skilling's transform), then
    interleave the bits."""
    x = x.astype(np.uint64)
    p = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(p):
            on = (x[:, i] & q) > 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] = np.where(on, x[:, 0] ^ low, x[:, 0]) ^ swap
            x[:, i] ^= swap
    for i in range(1, p):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[:, p - 1] >> np.uint64(level)) & np.uint64(1) > 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn[:, None]
    key = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(p):
            key = key << np.uint64(1) | (x[:, i] >> np.uint64(level)) & np.uint64(1)
    return key


class Curves:
    """Projections, quantiles and shifts of all curves."""

    def __init__(self, sample: np.ndarray, largest: float, curves: int, dims: int, bits: int):
        rng = np.random.default_rng(3)
        self.largest, self.bits, size = largest, bits, sample.shape[1] + 1
        dims = min(dims, size)
        self.project = [np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dims] for _ in range(curves)]
        self.shift = rng.random((curves, dims))
        at = np.linspace(0, 1, KNOTS)
        self.knots = [np.quantile(self.lift(sample, False) @ p, at, axis=0) for p in self.project]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        square = (x * x).sum(1)
        if query:
            return np.hstack([x * (self.largest / np.sqrt(square))[:, None], np.zeros((len(x), 1))])
        return np.hstack([x, np.sqrt(np.maximum(0, self.largest**2 - square))[:, None]])

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(points, curves) Hilbert indexes."""
        out = np.empty((len(x), len(self.project)), np.int64)
        lifted = self.lift(x, query)
        for c, p in enumerate(self.project):
            y = lifted @ p
            u = np.stack([np.interp(y[:, i], self.knots[c][:, i], np.linspace(0, 1, KNOTS)) for i in range(y.shape[1])], axis=1)
            cell = ((u + self.shift[c]) / 2 * (1 << self.bits)).astype(np.int64)
            out[:, c] = hilbert(np.clip(cell, 0, (1 << self.bits) - 1), self.bits).view(np.int64)
        return out


def _matrix(col: pa.Array, size: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), size)


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def best(points: np.ndarray, low: np.ndarray, query: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the ``k`` points nearest to ``query``, ties to
    the smaller ``low``. ``near``: rough scores of all points."""
    if len(near) > k:
        edge = np.partition(near, len(near) - k)[len(near) - k]
        some = np.flatnonzero(near >= edge - 1e-9 * (1 + abs(edge)))
    else:
        some = np.arange(len(near))
    exact = (points[some] * query).sum(1)
    order = np.lexsort((low[some], -exact))[:k]
    return some[order], exact[order]


def _compare(batches: Iterator[pa.RecordBatch], size: int, k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a segment lie together, points before queries."""
    group, parts, block = None, [], None
    for b in batches:
        b = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names)
        curve, segment = b.column("curve").to_numpy(), b.column("segment").to_numpy()
        query = b.column("query").to_numpy(zero_copy_only=False)
        change = np.flatnonzero((np.diff(curve) != 0) | (np.diff(segment) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
        for a, z in zip([0, *change.tolist()], [*change.tolist(), len(curve)]):
            mine = int(curve[a]), int(segment[a])
            if mine != group:
                group, parts, block = mine, [], None
            rows = b.slice(a, z - a)
            x, node, low = _matrix(rows.column("vector"), size), rows.column("node").to_numpy(), rows.column("low").to_numpy()
            if not query[a]:
                parts.append((x, node, low))
                continue
            if not parts and block is None:
                continue
            if parts:
                block, parts = [np.concatenate(v) for v in zip(*parts)], []
            points, nodes, lows = block
            out = {n: [] for n in names}
            for i in range(0, len(x), 256):
                rough = x[i : i + 256] @ points.T
                for j, near in enumerate(rough):
                    at, score = best(points, lows, x[i + j], near, k)
                    for n, v in zip(names, (node[i + j], nodes[at], lows[at], score)):
                        out[n].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[names[0]], pa.int64()), *(pa.array(out[n], pa.list_(t)) for n, t in zip(names[1:], (pa.int64(), pa.int64(), pa.float64())))], names=names)


def _merge(batches: Iterator[pa.RecordBatch], k: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Best of all that a query has found; its rows lie together."""
    held, group = [], None

    def done() -> pa.RecordBatch:
        node, low, score = (np.concatenate(v) for v in zip(*held))
        _, one = np.unique(node, return_index=True)
        one = one[np.lexsort((low[one], -score[one]))[:k]]
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), *(pa.array([v[one]]) for v in (node, low, score))], names=names)

    for b in batches:
        for q, *cols in zip(b.column(0).to_pylist(), *(b.column(i) for i in (1, 2, 3))):
            if q != group and held:
                yield done()
                held = []
            group = q
            held.append([c.values.to_numpy() for c in cols])
    if held:
        yield done()


FOUND = T.StructType([T.StructField("q", T.LongType()), T.StructField("nodes", T.ArrayType(T.LongType())), T.StructField("lows", T.ArrayType(T.LongType())), T.StructField("scores", T.ArrayType(T.DoubleType()))])


def _sample_neighbours(points: DataFrame, queries: np.ndarray, nodes: list[int], size: int, k: int) -> dict[int, list[int]]:
    """The ``k`` nearest points of each sample query, by comparing with all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {n: [] for n in nodes}
        for b in batches:
            x, node, low = _matrix(b.column("vector"), size), b.column("node").to_numpy(), b.column("low").to_numpy()
            for q, n, near in zip(queries, nodes, queries @ x.T):
                at, score = best(x, low, q, near, k)
                found[n] = [*found[n], *zip((-score).tolist(), low[at].tolist(), node[at].tolist())]
                found[n] = sorted(found[n])[:k]
        rows = [(n, [x[2] for x in f], [x[1] for x in f], [-x[0] for x in f]) for n, f in found.items() if f]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())))], names=FOUND.names)

    near = points.select("vector", "node", "low").mapInArrow(run, FOUND).repartition("q").sortWithinPartitions("q")
    return {r.q: r.nodes for r in near.mapInArrow(lambda it: _merge(it, k, FOUND.names), FOUND).collect()}  # one row per sample query


def choose_width(places: DataFrame, true: dict[int, list[int]], target: float) -> int:
    """Places within which ``target`` of the sample's neighbours lie on some curve."""
    wanted = sorted({n for q, found in true.items() for n in [q, *found]})
    if not wanted:
        return 0
    rows = places.where(F.col("node").isin(wanted)).select("curve", "node", "query", "place").collect()  # sample queries x k x curves
    at = {(r.curve, r.node, r.query): r.place for r in rows}
    curves = {r.curve for r in rows}
    gaps = sorted(min(abs(at[c, q, True] - at[c, n, False]) for c in curves) for q, found in true.items() for n in found if n != q)
    return gaps[min(len(gaps) - 1, int(target * len(gaps)))] + 1 if gaps else 0


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
           curves: int = CURVES, dims: int = DIMS, bits: int = BITS, target: float = TARGET, segment: int = SEGMENT) -> DataFrame:
    """query_id, rank (from 1), key and score of the ``k`` nearest rows found for
    each row with ``is_query`` (a condition on the input's columns), itself excepted."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    rows = rows.where(F.col("id").isNotNull() & _valid(F.col("vector"))).withColumn("size", F.size("vector"))
    sizes = rows.groupBy("size").agg(F.max("query").alias("asked")).where("asked").orderBy("size").collect()  # one row per length
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    pairs = reduce(DataFrame.union, [_pairs(rows.where(F.col("size") == r.size).drop("size"), r.size, k, curves, dims, bits, target, segment) for r in sizes])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.select("query_id", rank.alias("rank"), F.col("id").alias(key), "score").where(F.col("rank") <= k)


def _pairs(rows: DataFrame, size: int, k: int, curves: int, dims: int, bits: int, target: float, segment: int) -> DataFrame:
    """query_id, score and id of at least the ``k`` nearest found, for vectors of one length."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["vector"].dataType
    rows = rows.withColumn("h", F.xxhash64("vector"))
    # the smallest ids of each class, repeated rows counting once: both steps cut in each task before their shuffle
    once = rows.select("id", "h", "vector").distinct()
    top = once.withColumn("r", F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = top.groupBy("h", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.withColumn("low", F.element_at("ids", 1))
    points = materialize(classes.withColumn("node", F.monotonically_increasing_id()))
    asked = rows.where("query").select("id", "h", "vector").distinct()
    asked = materialize(asked.join(points.select("h", "vector", "node"), ["h", "vector"]).select("id", "node"))
    askers = materialize(points.join(asked.select("node").distinct(), "node", "left_semi"))

    largest = points.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()[0]
    sample = points.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_POINTS).select("vector").collect()  # bounded
    shape = Curves(np.array([r.vector for r in sample], np.float64), largest, curves, dims, bits)
    keyed = T.StructType([T.StructField("node", T.LongType()), T.StructField("low", T.LongType()), T.StructField("vector", kind), T.StructField("query", T.BooleanType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query = b.column("query").to_numpy(zero_copy_only=False)
            x = _matrix(b.column("vector"), size)
            keys = np.where(query[:, None], shape.keys(x, True), shape.keys(x, False))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keyed.names[:-1]), pa.array(list(keys), pa.list_(pa.int64()))], names=keyed.names)

    both = points.select("node", "low", "vector", F.lit(False).alias("query")).union(askers.select("node", "low", "vector", F.lit(True)))
    on_curves = both.mapInArrow(place, keyed).select("node", "low", "vector", "query", F.posexplode("keys").alias("curve", "key"))
    order = [F.col(c) for c in ("curve", "key", "node", "query")]
    ranked = global_index(on_curves.drop("low"), order, "_at", parts, total="_all")
    per_curve = F.col("_all") / curves
    places = materialize(ranked.withColumn("place", (F.col("_at") - F.col("curve") * per_curve).cast("long")).drop("_at", "key"))

    chosen = askers.orderBy(F.xxhash64("node", F.lit(1)), "node").limit(SAMPLE_QUERIES).select("node", "vector").collect()  # bounded
    true = _sample_neighbours(points, np.array([r.vector for r in chosen], np.float64).reshape(len(chosen), size), [r.node for r in chosen], size, k + 1)
    width = choose_width(places, true, target)

    places = places.join(points.select("node", "low"), "node")
    last = F.floor((F.col("_all") / curves - 1) / segment)
    spread = F.sequence(F.floor(F.greatest(F.lit(0), F.col("place") - width) / segment), F.least(last, F.floor((F.col("place") + width) / segment)))
    own = F.array(F.floor(F.col("place") / segment))
    dealt = places.withColumn("segment", F.explode(F.when(F.col("query"), spread).otherwise(own)))
    dealt = dealt.select("curve", "segment", "query", "node", "low", "vector").repartition(parts, "curve", "segment").sortWithinPartitions("curve", "segment", "query")
    found = dealt.mapInArrow(lambda it: _compare(it, size, k + 1, FOUND.names), FOUND).repartition(parts, "q").sortWithinPartitions("q")
    nearest = found.mapInArrow(lambda it: _merge(it, k + 1, FOUND.names), FOUND)
    nearest = nearest.select("q", F.explode(F.arrays_zip("nodes", "scores")).alias("f")).select("q", F.col("f.nodes").alias("node"), F.col("f.scores").alias("score"))
    named = nearest.join(points.select("node", F.explode("ids").alias("id")), "node").drop("node")
    return asked.select(F.col("id").alias("query_id"), F.col("node").alias("q")).join(named, "q").where("id <> query_id").select("query_id", "id", "score")
