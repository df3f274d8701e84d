"""N-gram Jaccard join: pairs of documents whose sets of word n-grams have a
similarity of at least ``threshold``, by MinHash banding and exact verification.

1. Each document's n-gram set gives a MinHash signature in bands; rows and
   bands are chosen for a recall at the threshold. Documents with one and the
   same set form a class of copies and go on as one representative.
2. Representatives shuffle on their band hashes. Those of a bucket are joined to
   its smallest member only (counts first, buckets of one dropped), never pair
   by pair; components of these stars hold all candidate pairs.
3. Components meet their texts and are verified on full n-gram sets: a small one
   in one task, a large one dealt into blocks, each pair of blocks in a task of
   its own, which counts links and keeps a spanning forest, so that no pair
   becomes a row. All pairs of a component are compared, so links that banding
   alone would miss inside it are found as well.
4. Components of the links are the classes.

A document with 1 to n - 1 words has one n-gram, all its words. One without
words (or a null text) is similar to none and is a class by itself. A null key is
kept as null. Repeated rows are copies. Very long texts are taken whole. An empty table gives an empty result.
Other columns of the input are ignored."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, words
from claimwise.llm.components import connected
from claimwise.llm.mixing import free
from claimwise.llm.ship import ship
from claimwise.session import materialize

GRAM = 5
THRESHOLD = 0.8
RECALL = 0.9999  # of pairs just at the threshold
HASHES = 256  # MinHash values at most
BLOCK_DOCS, BLOCK_GRAMS = 256, 500_000  # of a large component, per block, about
COLUMNS = 16_384  # n-grams per step of the verification


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence fewest false candidates, with which the
    bands for ``recall`` at ``threshold`` need no more than ``hashes``."""
    best = None
    for rows in range(1, 65):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if best is None or bands * rows <= hashes:
            best = bands, rows
        else:
            break
    return best


def gram_sets(offsets: np.ndarray, raw: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct n-grams of each document, ascending; bounds)."""
    w = words.words(offsets, raw)
    h = words.mix(words.ngrams(w.hash, n))
    sets, bounds = [], [0]
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= n:
            sets.append(np.unique(h[a : z - n + 1]))
        elif z > a:
            sets.append(words.mix(words.ngrams(w.hash[a:z], z - a) + np.uint64(z - a)))
        bounds.append(bounds[-1] + (len(sets[-1]) if z > a else 0))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array(bounds)


def band_hashes(grams: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents with n-grams, bands) hashes."""
    start = bounds[:-1][np.diff(bounds) > 0]
    if not len(start):
        return np.zeros((0, bands), np.int64)
    rng = np.random.default_rng(11)
    by = rng.integers(0, 1 << 32, (bands, rows), dtype=np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, (bands, rows), dtype=np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(start), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            h = np.full(len(start), b + 1, np.uint64)
            for r in range(rows):
                h = words.mix(h ^ np.minimum.reduceat(x * by[b, r] + plus[b, r], start).astype(np.uint64))
            out[:, b] = h
    return out.view(np.int64)


def copy_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, key: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """Table of key, text_hash, n_grams, copy_key, bands (null without n-grams)
    and node, a number of its own for each row."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n_grams", T.LongType()), T.StructField("copy_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, text):
            grams, bounds = gram_sets(*arrow.buffers(b.column(text)), n)
            size = np.diff(bounds)
            some = size > 0
            made = iter(band_hashes(grams, bounds, bands, rows))
            cells = [next(made) if s else None for s in some.tolist()]
            keys = [copy_key(grams[a:z]) if z > a else None for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("text_hash"), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(cells, pa.list_(pa.int64()))], names=schema.names)

    rows_in = docs.select(key, text, F.xxhash64(text).alias("text_hash"))
    return materialize(rows_in.mapInArrow(run, schema).withColumn("node", F.monotonically_increasing_id()))


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of links between the sets at ``left`` and at ``right``."""
    size = np.array([len(s) for s in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = count[col] > 1  # n-grams of one document meet nothing
    row, col = row[use], (np.cumsum(count > 1) - 1)[col[use]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(left), len(right)))
    edges = np.searchsorted(col, np.arange(0, int(col[-1]) + 1 + COLUMNS if len(col) else 0, COLUMNS))
    for k, (a, z) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[a:z], col[a:z] - k * COLUMNS] = 1
        common += m[left] @ m[right].T
    either = size[left][:, None] + size[right][None, :] - common
    return common >= threshold * either - 1e-9


def _roots(n: int, links: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def _verify(batches: Iterator[pa.RecordBatch], n: int, threshold: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a (component, block pair) lie together and in order."""
    held: dict[int, dict] = {}  # by node: identical rows of the input count once
    group = None

    def done() -> pa.RecordBatch:
        rows = [held[k] for k in sorted(held)]
        block = np.array([r["block"] for r in rows])
        i, j = rows[0]["i"], rows[0]["j"]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        copies = np.array([r["copies"] for r in rows])
        texts, docs = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        links = []
        if len(left) and len(right):
            yes = _similar([r["grams"] for r in rows], left, right, threshold)
            if i == j:
                np.fill_diagonal(yes, False)
            texts[left], docs[left] = yes.sum(1), yes @ copies[right]
            if i != j:
                texts[right], docs[right] = yes.sum(0), yes.T @ copies[left]
            a, b = np.nonzero(yes)
            links = list(zip(left[a].tolist(), right[b].tolist()))
        root = _roots(len(rows), links)
        node = np.array([r["node"] for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(node[root], pa.int64()), pa.array(texts), pa.array(docs), pa.array([rows[0]["whole"]] * len(rows))], names=names)

    for b in arrow.slices(batches, "text"):
        grams, bounds = gram_sets(*arrow.buffers(b.column("text")), n)
        for k, r in enumerate(b.drop_columns(["text"]).to_pylist()):
            mine = r["comp"], r["i"], r["j"]
            if mine != group and held:
                yield done()
                held.clear()
            group = mine
            s = grams[bounds[k] : bounds[k + 1]]
            if copy_key(s) == r["copy_key"]:
                held.setdefault(r["node"], r | {"grams": s})
    if held:
        yield done()


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD,
                 recall: float = RECALL) -> DataFrame:
    """One row per document: key, class_id (smallest key of its class: the
    documents that links connect), copy_of (smallest key with the same n-grams),
    n_links (other documents with a similarity of ``threshold`` or more),
    n_grams, text_hash, and keep (true for one row of each class, that of
    class_id)."""
    spark = docs.sparkSession
    ship(spark)
    bands, rows = choose_bands(threshold, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sig = signatures(docs, key, text, n, bands, rows)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), key, "node", "text_hash", "n_grams")).alias("f")
    reps = sig.where("n_grams > 0").groupBy("copy_key").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands"))
    reps = materialize(reps.select("copy_key", F.col(f"f.{key}").alias("rep_key"), "f.node", "f.text_hash", "f.n_grams", "copies", "bands"))

    placed = reps.select(F.explode("bands").alias("band"), "node")
    full = placed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    edges = placed.join(full, "band").select(F.col("node").alias("u"), F.col("low").alias("v"))
    found = connected(edges)
    comps = found.union(found.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "comp")
    comps = comps.join(reps.drop("bands"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK_DOCS), F.sum("n_grams") / F.lit(BLOCK_GRAMS))).cast("int")
    comps = comps.join(comps.groupBy("comp").agg(blocks.alias("blocks")), "comp")
    comps = materialize(comps.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    texts = docs.select(F.col(key).alias("rep_key"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    # always by shuffle, so that texts move alike at every size
    with_text = texts.alias("d").join(comps.hint("merge").alias("c"), F.col("d.rep_key").eqNullSafe(F.col("c.rep_key")) & (F.col("d.text_hash") == F.col("c.text_hash")))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j"))))
    dealt = with_text.select("comp", "node", "block", "copies", "copy_key", (F.col("blocks") == 1).alias("whole"), "text", pair.alias("p"))
    dealt = dealt.select("comp", "p.i", "p.j", "node", "block", "copies", "copy_key", "whole", "text")
    dealt = dealt.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "root", "texts", "docs")] + [T.StructField("whole", T.BooleanType())])
    checked = materialize(dealt.mapInArrow(lambda it: _verify(it, n, threshold, schema.names), schema))

    parted = connected(checked.where("not whole").select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = checked.where("whole and root != node").select("node", "root").union(parted)
    links = checked.groupBy("node").agg(F.sum("docs").alias("linked"))
    member = reps.select("node", "copy_key", "copies", "rep_key").join(roots, "node", "left").join(links, "node", "left")
    member = member.withColumn("root", F.coalesce("root", "node"))
    lead = F.min(F.struct(F.col("rep_key").isNull().alias("none"), "rep_key", "node")).alias("lead")
    member = member.join(member.groupBy("root").agg(lead), "root")
    member = member.select("copy_key", F.col("lead.rep_key").alias("class_id"), F.col("rep_key").alias("copy_of"), F.col("lead.node").alias("lead"),
                           (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = sig.drop("bands").join(member, "copy_key", "left")
    alone = F.col("copy_key").isNull()
    return out.select(key, F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
                      F.when(alone, F.col(key)).otherwise(F.col("copy_of")).alias("copy_of"),
                      F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_grams", "text_hash",
                      (alone | (F.col("node") == F.col("lead"))).alias("keep"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = GRAM, threshold: float = THRESHOLD,
                recall: float = RECALL) -> DataFrame:
    """The documents with all their columns, one of each class: the one with the
    smallest key. Rows with equal key and text count as one."""
    judged = jaccard_join(docs, key, text, n, threshold, recall).where("keep")
    own, held, known = (free(c, docs) for c in ("_own", "_key", "_hash"))
    use = judged.select(F.col(key).alias(held), F.col("text_hash").alias(known)).hint("merge")
    met = docs.withColumn(own, F.xxhash64(text)).join(use, F.col(key).eqNullSafe(F.col(held)) & (F.col(own) == F.col(known)), "left_semi")
    return met.dropDuplicates([key, own]).drop(own)
