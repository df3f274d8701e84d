"""Substring dedup: words of long passages that occur earlier are removed.

A window is WINDOW consecutive words of one document. A window is a repeat
if its word sequence also starts earlier (smaller key, or same document and
earlier start; rows of one key in the order in which they are met). All words
that repeats cover are removed.

Method. The residues of a difference cover modulo PERIOD hold, for every
shift, two members that differ by it. So of any two equal windows, some
position in the first PERIOD is a cover position in both documents, and the
ANCHOR words from there (WINDOW - PERIOD + 1 of them) are equal. Three passes:

1. hash the anchors at cover positions only (4 of 13 words), once per chunk
   of documents, and find the hashes that occur in two places;
2. extend: windows around such shared anchors are hashed whole (96 bits),
   and of equal windows the earliest is found;
3. with the repeats known, documents are cut.

Documents travel as chunks (compressed rows of a table of their own, a few MB of
text each), hashes as sorted, packed arrays, one cell per chunk and hash
range. A hash counts once per chunk, so a passage in a third of all documents
costs each range task one entry per chunk, and no pairs are ever made.

Nulls: a null text has no words; a null key counts as smallest. Repeated rows are
documents of their own, and the later ones lose their windows. Texts with fewer
than WINDOW words stay whole. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, words
from claimwise.llm.cells import CELL, by_part, cells, merge, ranged, split
from claimwise.llm.ship import ship
from claimwise.session import materialize

WINDOW = 20
# A difference cover (perfect difference set) modulo 13.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
SECOND = 0xD6E8FEB86659FD93  # another odd multiplier, for the windows' second hash
CHUNK_BYTES = 4 << 20  # text per chunk
CHUNK = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("docs", T.BinaryType()), T.StructField("more", T.BinaryType())])
KINDS = {"long": pa.int64(), "string": pa.string()}
SIDE = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("cell", T.BinaryType())])


def _pack_docs(keys: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, raw: np.ndarray) -> bytes:
    head = np.array([len(keys)], "<i8").tobytes()
    body = head + keys.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes() + offsets.astype("<i8").tobytes() + raw.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


class Chunk:
    """Documents of a chunk in ascending key order (nulls first)."""

    def __init__(self, cell: bytes):
        body = zstandard.ZstdDecompressor().decompress(cell)
        n = int(np.frombuffer(body, "<i8", 1)[0])
        self.keys = np.frombuffer(body, "<i8", n, 8)
        self.nulls = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(bool)
        self.offsets = np.frombuffer(body, "<i8", n + 1, 8 + 9 * n)
        self.raw = np.frombuffer(body, np.uint8, -1, 16 + 17 * n) if self.offsets[-1] else np.zeros(0, np.uint8)
        self.words = words.words(self.offsets, self.raw)


def chunks(docs: DataFrame, key: str, text: str, carry: list[str]) -> DataFrame:
    """The documents as rows (chunk, docs, more) of a table; ``more`` holds the
    columns to carry along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for b in arrow.slices(batches, text, CHUNK_BYTES):
            b = b.take(pc.sort_indices(b.column(key), null_placement="at_start"))
            k = b.column(key)
            offsets, raw = arrow.buffers(b.column(text))
            cell = _pack_docs(k.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(k.is_null()), offsets, raw)
            more = _ipc(b.select(carry)) if carry else None
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([cell], pa.binary()), pa.array([more], pa.binary())], names=CHUNK.names)
            number += 1

    return materialize(docs.select(F.col(key).cast("long").alias(key), text, *carry).mapInArrow(run, CHUNK))


def _ipc(b: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _cover(w: words.Words) -> np.ndarray:
    """Whether each word is at a cover position of its document."""
    place = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))) % PERIOD
    return np.isin(place, COVER)


def _anchors(w: words.Words, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(mixed hash, word index) of the anchors of a chunk."""
    h = words.ngrams(w.hash, anchor)
    at = np.flatnonzero(_cover(w)[: len(h)] & words.inside(w.first, anchor))
    return words.mix(h[at]), at


def _windows(w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the window from each word on."""
    return words.mix(words.ngrams(w.hash, window)), words.mix(words.ngrams(w.hash, window, SECOND))


def _repeated(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether an earlier place has the same pair of hashes."""
    return pd.Series(h).duplicated().to_numpy() & pd.Series(g).duplicated().to_numpy()


def _candidates(w: words.Words, shared: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Windows that hold a shared anchor at a cover position in their first
    PERIOD words (all windows that can have an equal one do)."""
    h, at = _anchors(w, anchor)
    k = np.minimum(np.searchsorted(shared, h), max(0, len(shared) - 1))
    hit = at[shared[k] == h] if len(shared) else at[:0]
    mark = np.zeros(len(w.hash) + 1, np.int64)  # +1 where windows around a hit begin, -1 after they end
    np.add.at(mark, np.maximum(hit - (window - anchor), 0), 1)
    np.add.at(mark, hit + 1, -1)
    near = np.cumsum(mark)[: max(0, len(w.hash) - window + 1)] > 0
    return np.flatnonzero(near & words.inside(w.first, window))


def find_repeats(table: DataFrame, window: int = WINDOW) -> DataFrame:
    """(chunk, cells): for chunks with repeats that start in another chunk, packed
    word indexes of the windows concerned."""
    spark = table.sparkSession
    anchor, parts = window - PERIOD + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))

    def anchor_cells(batches):
        for b in batches:
            for r in b.to_pylist():
                h, n = np.unique(_anchors(Chunk(r["docs"]).words, anchor)[0], return_counts=True)
                yield cells(r["chunk"], parts, h, np.minimum(n, 2).astype(np.uint8))

    def shared_anchors(batches):
        for _, group in by_part(batches):
            keys, n, owner = merge(group)
            u, start = np.unique(keys, return_index=True)
            twice = np.add.reduceat(n[:, 0].astype(np.int64), start) >= 2 if len(u) else np.zeros(0, bool)
            hit = np.repeat(twice, np.diff(start, append=len(keys)))
            for chunk, mine in split(owner[hit], keys[hit]):
                yield _side(group[chunk][0], arrow.pack_sorted(mine))

    sent = table.select("chunk", "docs").mapInArrow(anchor_cells, CELL)
    shared = materialize(ranged(sent, parts).mapInArrow(shared_anchors, SIDE))

    def window_cells(batches):
        for b in batches:
            for r in b.to_pylist():
                w = Chunk(r["docs"])
                known = np.unique(np.concatenate([arrow.unpack_sorted(c)[0] for c in r["cells"]]))
                at = _candidates(w.words, known, window, anchor)
                h, g = _windows(w.words, window)
                one = at[~_repeated(h[at], g[at])]
                one = one[np.argsort(h[one], kind="stable")]
                doc = np.searchsorted(w.words.first, one, "right") - 1
                key = np.where(w.nulls[doc], np.iinfo(np.int64).min, w.keys[doc])
                yield cells(r["chunk"], parts, h[one], (g[one] >> np.uint64(32)).astype(np.uint32), one.astype(np.uint32), key.astype(np.int64))

    def later_windows(batches):
        for _, group in by_part(batches):
            keys, cols, owner = merge(group)
            check, at, doc = cols[:, 0], cols[:, 1], cols[:, 2]
            chunk = np.array([c for c, _ in group])[owner]
            order = np.lexsort((at, chunk, doc, check, keys))
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (keys[a] == keys[b]) & (check[a] == check[b])
            later = order[same]
            for k, mine in split(owner[later], at[later]):
                yield _side(group[k][0], arrow.pack_sorted(np.sort(mine).astype(np.uint64)))

    met = table.select("chunk", "docs").join(_gather(shared), "chunk")
    return _gather(ranged(met.mapInArrow(window_cells, CELL), parts).mapInArrow(later_windows, SIDE))


def _side(chunk: int, cell: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([cell], pa.binary())], names=SIDE.names)


def _gather(side: DataFrame) -> DataFrame:
    """One row per chunk; its cells are bounded by its own words."""
    return side.groupBy("chunk").agg(F.collect_list("cell").alias("cells"))


def removed_words(c: Chunk, cells: list[bytes] | None, window: int) -> np.ndarray:
    """Which words of a chunk go: those in windows that repeat one of another
    chunk (``cells``) or an earlier one of this chunk."""
    w = c.words
    gone = np.zeros(len(w.hash) + 1, np.int64)
    h, g = _windows(w, window)
    at = np.flatnonzero(words.inside(w.first, window))
    later = np.zeros(len(w.hash), bool)
    later[at[_repeated(h[at], g[at])]] = True
    if cells:
        # equal windows of this chunk were sent once; all of them repeat what the first does
        sent = np.zeros(len(w.hash), bool)
        sent[np.concatenate([arrow.unpack_sorted(x)[0] for x in cells]).astype(np.int64)] = True
        later |= sent
    start = np.flatnonzero(later)
    np.add.at(gone, start, 1)
    np.add.at(gone, start + window, -1)
    return np.cumsum(gone)[:-1] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   texts: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per document: key, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space), with ``texts`` the kept text (the input's own
    characters before and after each removed run), and the columns to ``carry``."""
    ship(docs.sparkSession)
    if window <= PERIOD:
        raise ValueError(f"window must exceed {PERIOD}")
    table = chunks(docs, key, text, list(carry))
    met = table.join(find_repeats(table, window), "chunk", "left")
    fields = [T.StructField(key, T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField(text, T.StringType())] if texts else []
    own = [f.name for f in fields]
    if twice := set(own) & set(carry):
        raise ValueError(f"columns to carry have names of the result: {sorted(twice)}")
    schema = T.StructType(fields + [docs.schema[c] for c in carry])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                c = Chunk(r["docs"])
                gone = removed_words(c, r["cells"], window)
                w, whole = c.words, c.raw.tobytes()
                rows = {f: [] for f in own}
                for d, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
                    mine = gone[a:z]
                    kept = np.flatnonzero(~mine) + a
                    body = whole[int(c.offsets[d]) : int(c.offsets[d + 1])]
                    lost = z - a - len(kept)
                    plain = body.split() if not lost else [whole[s:e] for s, e in zip(w.start[kept].tolist(), w.end[kept].tolist())]
                    rows[key].append(None if c.nulls[d] else int(c.keys[d]))
                    rows["n_words"].append(z - a)
                    rows["n_removed"].append(lost)
                    rows["kept_sha256"].append(hashlib.sha256(b" ".join(plain)).hexdigest())
                    if texts:
                        rows[text].append((body if not lost else _cut(whole, c, w, gone, d)).decode())
                done = pa.RecordBatch.from_pydict(rows, schema=pa.schema([(f, KINDS[fields[i].dataType.typeName()]) for i, f in enumerate(own)]))
                if carry:
                    more = pa.ipc.open_stream(r["more"]).read_all().combine_chunks().to_batches()[0]
                    done = pa.RecordBatch.from_arrays([*done.columns, *more.columns], names=schema.names)
                yield done

    return met.select("docs", "more", "cells").mapInArrow(run, schema)


def _cut(whole: bytes, c: Chunk, w: words.Words, gone: np.ndarray, d: int) -> bytes:
    """Text of document ``d`` without its removed words and the white space
    after each of them."""
    a, z = int(w.first[d]), int(w.first[d + 1])
    edge = np.flatnonzero(np.diff(gone[a:z].astype(np.int8), prepend=0, append=0)) + a
    out, at = [], int(c.offsets[d])
    for lost, back in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(whole[at : int(w.start[lost])])
        at = int(w.start[back]) if back < z else int(c.offsets[d + 1])
    return b"".join([*out, whole[at : int(c.offsets[d + 1])]])

