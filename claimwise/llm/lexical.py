"""Ranked lexical search over an index of document segments, exact to the integer.

``build_index`` cuts the documents into segments of about SEGMENT_BYTES of text.
A segment is one row: its terms, and for each term the documents that hold it and
how often, in packed cells. All terms of all texts are indexed; nothing is grouped
by term over segments, so a frequent term is never in one task.

``search`` scores every segment for every item by a hybrid of two ways of reading
lists. Short lists are read term at a time: their summed contributions become
accumulators, kept in document order. These then act as one more list, bounded by
the largest of them, among the long lists, which are read document at a time in runs
of documents: lists whose bounds together cannot reach the item's k-th best score
give no candidates, only the others do, and a non-essential list is looked up just
for the candidates still within reach. The k-th best score is carried
from segment to segment of a task; a segment whose bounds stay below it is skipped.
Every skipped document lies strictly below the k-th score, so results are exact.

Items are taken in blocks of about BLOCK_BYTES of distinct terms (the block is what
a task and the driver hold); each block reads the whole index once.

A null text has no terms; empty texts count as documents without terms. Texts of any
length are read whole, in pieces. Each row of documents is ranked by itself, also
where rows repeat; equal scores are ordered by document id, null last. Rows of one
item id (null is one too) are one item with the terms of all of them. Items without
a matching document have no rows; empty tables give an empty result. Only the key
and text columns are read, so no other column's name matters."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow
from claimwise.llm.ship import ship
from claimwise.session import materialize

SEGMENT_BYTES = 4 << 20
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
RUN = 1024  # documents looked at side by side
SHORT = 16  # a list with at most 1 / SHORT of the segment's documents is short

#: Bytes of a term: digits, letters (A-Z lower-cased) and all beyond ASCII.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))

_BINARY = ("keys", "nulls", "lengths", "terms", "df", "most", "least", "postings")
SEGMENT = T.StructType([T.StructField(c, T.LongType()) for c in ("n_docs", "n_with_terms", "n_terms")] + [T.StructField(c, T.BinaryType()) for c in _BINARY])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("item", "doc_id", "score")])


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    text, at = text.translate(FOLD), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _zip(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzip(cell: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def _segment(keys: pa.Array, texts: pa.Array) -> dict:
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__  # terms are numbered as they appear
    n, parts = [], [np.zeros(0, np.int64)]
    for text in arrow.texts(texts):
        pieces = [np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)) for ws in terms_of(text)]
        n.append(sum(map(len, pieces)))
        parts += pieces
    docs, n = len(n), np.array(n, np.int64)
    pairs, tf = np.unique(np.concatenate(parts) * docs + np.repeat(np.arange(docs), n), return_counts=True)
    df = np.bincount(pairs // docs, minlength=len(number))
    first = np.cumsum(df) - df
    most = np.maximum.reduceat(tf, first) if len(df) else df
    least = np.minimum.reduceat(n[pairs % docs], first) if len(df) else df
    return {
        "n_docs": docs, "n_with_terms": int((n > 0).sum()), "n_terms": int(n.sum()),
        "keys": _zip(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()),
        "nulls": _zip(np.asarray(keys.is_null()).astype(np.uint8).tobytes()),
        "lengths": _zip(n.astype("<u8").tobytes()), "terms": _zip(b" ".join(number)), "df": _zip(df.astype("<u4").tobytes()),
        "most": _zip(most.astype("<u8").tobytes()), "least": _zip(least.astype("<u8").tobytes()),
        "postings": arrow.pack_sorted(pairs, tf.astype(np.uint32 if not len(tf) or tf.max() < 1 << 32 else np.uint64)),
    }


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a segment, as a table on shared storage; documents stay in the task
    that reads them."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    schema = pa.schema([(f.name, pa.int64() if f.dataType == T.LongType() else pa.binary()) for f in SEGMENT])

    def run(batches):
        for b in arrow.slices(batches, "t", SEGMENT_BYTES):
            yield pa.RecordBatch.from_pylist([_segment(b.column("k"), b.column("t"))], schema=schema)

    return materialize(rows.mapInArrow(run, SEGMENT))


@dataclass
class Block:
    """Some items: their ids, and per item the places of its terms in ``terms``."""

    ids: list[int | None]
    items: list[np.ndarray]
    terms: dict[bytes, int]


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct (item, term)."""

    def run(batches):
        for b in arrow.slices(batches, "t"):
            ids, terms = [], []
            for k, t in zip(b.column("k").to_pylist(), arrow.texts(b.column("t"))):
                own = {w for ws in terms_of(t) for w in ws}
                ids += [k] * len(own)
                terms += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.binary())], names=["item", "term"])

    rows = items.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "item long, term binary").distinct()


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    wanted = materialize(_item_terms(items, key, text))
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for k in range(n):
        own = defaultdict(list)
        for r in wanted.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).collect():  # about BLOCK_BYTES
            own[r.item].append(bytes(r.term))
        terms = {t: i for i, t in enumerate(sorted({t for ts in own.values() for t in ts}))}
        yield Block(list(own), [np.array(sorted(terms[t] for t in ts)) for ts in own.values()], terms)


def _document_counts(index: DataFrame, terms: dict[bytes, int]) -> np.ndarray:
    """In how many documents each term of a block occurs."""

    def run(batches):
        total = np.zeros(len(terms), np.int64)
        for b in batches:
            for names, df in zip(b.column("terms").to_pylist(), b.column("df").to_pylist()):
                seg = _places(names, terms)
                total[seg >= 0] += _unzip(df, "<u4")[seg[seg >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["term", "df"])

    df = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "df").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[r[0]] = r[1]  # one row a term of the block
    return df


def _places(names: bytes, terms: dict[bytes, int]) -> np.ndarray:
    """Place in a segment's vocabulary of each term of a block, or -1."""
    seg, get = np.full(len(terms), -1), terms.get
    for i, t in enumerate(zstandard.ZstdDecompressor().decompress(names).split()):
        if (q := get(t)) is not None:
            seg[q] = i
    return seg


def _length_part(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 - 90 + (90 * n * docs) div total, also where the product needs more than 64 bits."""
    if not len(n) or int(n.max()) * 90 * docs < 1 << 63:
        return 10 + n.astype(np.int64) * (90 * docs) // total
    return np.array([10 + 90 * x * docs // total for x in n.tolist()], np.int64)


def _part(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What terms of weight ``w`` add to a score."""
    tf = tf.astype(np.int64)
    return w * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Top:
    """The k best (score, document) of one item so far; equal scores by id, null last."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1  # least score that can still enter
        self.rows = np.zeros((3, 0), np.int64)  # -score, null, id

    def add(self, score: np.ndarray, null: np.ndarray, key: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([-score, null.astype(np.int64), key])], axis=1)
        self.rows = rows[:, np.lexsort(rows[::-1])[: self.k]]
        if self.rows.shape[1] == self.k:
            self.floor = max(1, -int(self.rows[0, -1]))


class Segment:
    """One segment's lists for the terms of a block."""

    def __init__(self, row: dict, terms: dict[bytes, int], weights: np.ndarray, docs: int, total: int):
        self.place = _places(row["terms"], terms)
        self.place[weights <= 0] = -1  # adds nothing
        self.weights, self.n = weights, row["n_docs"]
        self.df = _unzip(row["df"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.df) - self.df
        have = self.place >= 0
        at = self.place[have]
        self.bound = np.zeros(len(terms), np.int64)
        least = _length_part(_unzip(row["least"], "<u8")[at], docs, total)
        self.bound[have] = _part(weights[have], _unzip(row["most"], "<u8")[at], least)
        self.row, self.stats, self.lists = row, (docs, total), {}
        self.pairs = None

    def _open(self) -> None:
        self.pairs, self.tf = arrow.unpack_sorted(self.row["postings"])
        self.m = _length_part(_unzip(self.row["lengths"], "<u8"), *self.stats)
        self.keys, self.nulls = _unzip(self.row["keys"], "<i8"), _unzip(self.row["nulls"], np.uint8)

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents ascending, what each gets from the term)."""
        if term not in self.lists:
            p = self.place[term]
            a = self.first[p]
            b = a + self.df[p]
            docs = (self.pairs[a:b] - np.uint64(p * self.n)).astype(np.int64)
            self.lists[term] = docs, _part(self.weights[term], self.tf[a:b], self.m[docs])
        return self.lists[term]

    def accumulate(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: the summed contributions of lists, in document order."""
        docs, parts = (np.concatenate(x) for x in zip(*map(self.list, terms)))
        order = np.argsort(docs, kind="stable")
        docs, parts = docs[order], parts[order]
        start = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
        return docs[start], np.add.reduceat(parts, start)

    def best(self, item: np.ndarray, top: Top) -> None:
        """Add this segment's documents to an item's best."""
        item = item[self.place[item] >= 0]
        if not len(item) or int(self.bound[item].sum()) < top.floor:
            return
        if self.pairs is None:
            self._open()
        short = self.df[self.place[item]] * SHORT <= self.n
        lists = [(int(self.bound[t]), *self.list(t)) for t in item[~short].tolist()]
        if short.any():
            docs, sums = self.accumulate(item[short].tolist())
            lists.append((int(sums.max()), docs, sums))
        lists.sort(key=lambda x: x[0])
        reach = np.cumsum([x[0] for x in lists])  # most that a list and those before it can add
        at = 0
        while at < self.n:
            free = int(np.searchsorted(reach, top.floor, "left"))  # lists that alone cannot reach the floor
            if free == len(lists):
                return
            at = min(int(docs[i]) if (i := int(np.searchsorted(docs, at))) < len(docs) else self.n for _, docs, _ in lists[free:])
            score = np.zeros(min(RUN, self.n - at), np.int64)
            for _, docs, parts in lists[free:]:
                a, b = np.searchsorted(docs, (at, at + len(score)))
                score[docs[a:b] - at] += parts[a:b]
            found = np.flatnonzero(score)
            score = score[found]
            for j in range(free - 1, -1, -1):
                within = score + reach[j] >= top.floor
                found, score = found[within], score[within]
                if not len(found):
                    break
                _, docs, parts = lists[j]
                i = np.minimum(np.searchsorted(docs, found + at), len(docs) - 1)
                score = score + np.where(docs[i] == found + at, parts[i], 0)
            within = score >= top.floor
            if within.any():
                d = found[within] + at
                top.add(score[within], self.nulls[d], self.keys[d])
            at += RUN


def search(index: DataFrame, items: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """Each item's ``k`` best documents with a score above 0: key, rank, doc_id, score."""
    spark = index.sparkSession
    ship(spark)
    docs, total = index.agg(F.sum("n_with_terms"), F.sum("n_terms")).first()
    parts = []
    for block in _blocks(items, key, text) if total else ():
        df = _document_counts(index, block.terms)
        weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        parts.append(materialize(index.mapInArrow(_searcher(block, weights, docs, total, k), FOUND)))
    found = parts[0] if parts else spark.createDataFrame([], FOUND)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(key), "rank", "doc_id", "score")


def _searcher(block: Block, weights: np.ndarray, docs: int, total: int, k: int):
    def run(batches):
        tops = [Top(k) for _ in block.items]
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment({c: b.column(c)[i].as_py() for c in b.schema.names}, block.terms, weights, docs, total)
                for item, top in zip(block.items, tops):
                    seg.best(item, top)
        rows = [(own, None if null else d, -s) for own, top in zip(block.ids, tops) for s, null, d in top.rows.T.tolist()]
        cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(cols, names=FOUND.names)

    return run
