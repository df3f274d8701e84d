"""Quality classifier: random-indexing word vectors pooled per document, and a
two-layer network whose probabilities are calibrated by a temperature.

1. Terms are words and shapes of words (runs of upper case, lower case and
   digits become one sign each: ``Then,`` is ``Xx,``), hashed to TERMS places
   each. Each term has a fixed sparse random index vector; its word vector is the
   sum of the index vectors met just before and after it anywhere in the
   corpus, of unit length. Each task adds up its documents' sums and sends
   them in compressed blocks; the result has a fixed size of a few MB. Texts
   are taken SLICE_BYTES at a time and word vectors PART words at a time, within
   long documents too, so that a worker holds little beside its input.
2. A document's features are means and mean squares of its terms' vectors, how
   alike neighbours are, and its length.
3. A network with one hidden layer is fitted on the driver, on labelled rows:
   all of them up to ``max_rows``, beyond that those with the smallest hash of
   the key. A fifth of the rows is held back to fit the temperature.

Nulls: a null or empty text has zero vectors, and gets a score like all others;
labels that are null, or whose document is missing, are not used. Repeated
rows are scored alike. Without labels every score is 0.5. An empty table gives
an empty result. Columns other than the text never enter a score."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, words
from claimwise.llm.ship import ship
from claimwise.session import materialize

TERMS = 1 << 14  # places for words, and as many for shapes
DIM = 32
SPARSE = 2  # nonzero entries of an index vector
BLOCKS = 32  # parts of the table of sums in the shuffle
SLICE_BYTES = 1 << 20  # of texts taken at a time
PART = 1 << 13  # words whose vectors are held at a time
MAX_ROWS = 20_000  # labelled rows fitted at most
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 128, 3e-3, 1e-4
FEATURES = 4 * DIM + 4

CLASS = np.arange(256, dtype=np.uint8)
CLASS[ord("A") : ord("Z") + 1] = ord("X")
CLASS[ord("a") : ord("z") + 1] = ord("x")
CLASS[0x80:] = ord("x")
CLASS[ord("0") : ord("9") + 1] = ord("9")
_rng = np.random.default_rng(23)
INDEX_DIM = np.argsort(_rng.random((2 * TERMS, DIM)), axis=1)[:, :SPARSE].copy()
INDEX_SIGN = _rng.choice(np.array([-1.0, 1.0]), (2 * TERMS, SPARSE))


def terms(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((words, 2) places of each word and its shape, first word of each document)."""
    w = words.words(offsets, raw)
    cls = CLASS[raw]
    keep = words.WORD[raw]
    keep[1:] &= cls[1:] != cls[:-1]
    keep[w.start] = True
    at = np.zeros(len(raw) + 1, np.int32 if len(raw) < 1 << 31 else np.int64)
    np.cumsum(keep, out=at[1:])
    shape = words.hashes(cls[keep], at[w.start].astype(np.int64), at[w.end].astype(np.int64))
    bits = np.uint64(64 - (TERMS.bit_length() - 1))
    return np.stack([w.hash >> bits, (shape >> bits) + np.uint64(TERMS)], axis=1).astype(np.int64), w.first


def _add_contexts(sums: np.ndarray, t: np.ndarray, first: np.ndarray) -> None:
    """Add each word's neighbours' index vectors to its terms."""
    new = np.zeros(len(t) + 1, bool)
    new[first] = True
    pairs = np.flatnonzero(~new[1 : len(t)])  # i and i + 1 lie in one document
    for lo in range(0, len(pairs), PART):
        pair = pairs[lo : lo + PART]
        for mine, other in ((pair, pair + 1), (pair + 1, pair)):
            for a in range(2):
                row = t[mine, a] * DIM
                for b in range(2):
                    source = t[other, b]
                    for k in range(SPARSE):
                        np.add.at(sums, row + INDEX_DIM[source, k], INDEX_SIGN[source, k])


def context_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(2 * TERMS, DIM) unit word vectors of all words and shapes; terms never
    met are zero. 4 MB, whatever the corpus."""
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("cell", T.BinaryType())])

    def cells(sums: np.ndarray) -> pa.RecordBatch:
        rows = [zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes()) for x in np.split(sums, BLOCKS)]
        return pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array(rows, pa.binary())], names=schema.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * TERMS * DIM)
        for b in arrow.slices(batches, text, SLICE_BYTES):
            _add_contexts(sums, *terms(*arrow.buffers(b.column(text))))
        yield cells(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, cell in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell.as_py()), "<i8")
                total[k] = total[k] + x if k in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=schema.names)

    rows = docs.select(text).mapInArrow(scan, schema).repartition(BLOCKS, "block").mapInArrow(add, schema).collect()
    sums = np.zeros((BLOCKS, 2 * TERMS * DIM // BLOCKS))
    for r in rows:
        sums[r.block] += np.frombuffer(r.cell, "<i8")
    vectors = sums.reshape(2 * TERMS, DIM)
    return (vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))).astype(np.float32)


def pool(offsets: np.ndarray, raw: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(documents, FEATURES) of a slice."""
    t, first = terms(offsets, raw)
    n = np.diff(first)
    out = np.zeros((len(n), FEATURES), np.float32)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    new = np.zeros(len(t) + 1, bool)
    new[first] = True
    joined = ~new[:-1]  # a word that has one before it in its document
    start = first[:-1][some]
    div = n[some].astype(np.float32)
    columns = np.ascontiguousarray(vectors.T)
    for a in range(2):
        place, alike = np.ascontiguousarray(t[:, a]), np.zeros(len(t), np.float32)
        for d in range(DIM):  # one number a word at a time, not all DIM
            x = columns[d].take(place)
            out[some, 2 * a * DIM + d] = np.add.reduceat(x, start) / div
            out[some, (2 * a + 1) * DIM + d] = np.add.reduceat(x * x, start) / div
        for lo in range(1, len(t), PART):
            v = vectors[place[lo - 1 : lo + PART]]
            alike[lo : lo + PART] = np.einsum("ij,ij->i", v[1:], v[:-1])
        out[some, 4 * DIM + a] = np.add.reduceat(alike * joined, start) / div
    same = np.zeros(len(t), np.float32)
    same[1:] = (t[1:, 0] == t[:-1, 0]) & joined[1:]
    out[some, 4 * DIM + 2] = np.add.reduceat(same, start) / div
    out[:, 4 * DIM + 3] = np.log1p(n)
    return out


def features(docs: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and features (FEATURES little-endian floats in a binary cell)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # 4 MB
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, text, SLICE_BYTES):
            x = pool(*arrow.buffers(b.column(text)), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


@dataclass
class Network:
    """score = sigmoid(logit / temperature)."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 5) -> Network:
    """Fit on rows not ``held``; the temperature on those that are. One class
    (or no rows) gives a constant."""
    rng = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    net = Network(np.zeros(FEATURES), np.ones(FEATURES), rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(np.unique(y[~held])) < 2:
        net.b2 = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return net
    tx, ty = x[~held], y[~held]
    net.mean, net.scale = tx.mean(0), tx.std(0) + 1e-3
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    z = (tx - net.mean) / net.scale
    theta = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, s = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(z))
        for k in range(0, len(z), BATCH):
            i = order[k : k + BATCH]
            h = np.tanh(z[i] @ theta[0] + theta[1])
            p = 1 / (1 + np.exp(-np.clip(h @ theta[2] + theta[3], -40, 40)))
            g = (p - ty[i]) / len(i)
            back = np.outer(g, theta[2]) * (1 - h * h)
            grads = [z[i].T @ back + DECAY * theta[0], back.sum(0), h.T @ g + DECAY * theta[2], np.array([g.sum()])]
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for j, d in enumerate(grads):  # Adam
                m[j] = 0.9 * m[j] + 0.1 * d
                s[j] = 0.999 * s[j] + 0.001 * d * d
                theta[j] = theta[j] - rate * m[j] / (1 - 0.9**step) / (np.sqrt(s[j] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = theta[0], theta[1], theta[2], float(theta[3][0])
    if held.any():
        logit, hy = net.logit(x[held]), y[held]
        loss = lambda t: np.logaddexp(0, np.where(hy > 0.5, -1, 1) * logit / t).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def fold(key: str, of: int):
    """crc32 of the key as text modulo ``of`` (null for a null key)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of


def train(table: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Network:
    """Fit on documents with a label whose fold (of 3) is not 1. Rows are chosen
    by key alone, and only the chosen ones' features move."""
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    named = table.select(key).where(fold(key, 3) != 1).distinct().join(marked, F.col(key) == F.col("_key"))
    named = named.select("_key", F.col(key).cast("string").alias("k"), F.col("_label").cast("double").alias("y"))
    chosen = named.orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = table.join(F.broadcast(chosen), F.col(key) == F.col("_key")).dropDuplicates(["k"])  # bounded: max_rows
    rows = rows.select("k", "y", "features").collect()
    rows.sort(key=lambda r: (zlib.crc32(r.k.encode()), r.k))
    x = np.frombuffer(b"".join(r.features for r in rows), "<f4").reshape(len(rows), FEATURES)
    y = np.array([r.y for r in rows]) > 0
    held = np.array([zlib.crc32(r.k.encode()) // 3 % 5 == 0 for r in rows], bool)
    return fit(x, y, held)


def score(table: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted of documents with features."""
    schema = T.StructType([T.StructField(key, table.schema[key].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, raw = arrow.buffers(b.column("features"))
            p = net.score(np.frombuffer(raw.tobytes(), "<f4").reshape(b.num_rows, FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    rows = table.select(key, F.coalesce(fold(key, 3) == 1, F.lit(False)).alias("held_out"), "features")
    return rows.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             max_rows: int = MAX_ROWS) -> DataFrame:
    """key, held_out, score and predicted of all documents."""
    table = materialize(features(docs, context_vectors(docs, text), key, text))
    return score(table, train(table, labels, key, label, max_rows), key)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
              max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents, with all their columns, whose prediction is 1. Training
    pools labelled documents only; texts are then pooled and judged where they
    lie, without a shuffle."""
    vectors = context_vectors(docs, text)
    names = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key")).distinct()
    some = docs.select(key, text).join(names, F.col(key) == F.col("_key"), "left_semi")
    net = train(materialize(features(some, vectors, key, text)), labels, key, label, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, text, SLICE_BYTES):
            yield b.filter(pa.array(net.score(pool(*arrow.buffers(b.column(text)), shared.value)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
