"""Packing: cut tokenised documents into pieces and place them in windows of
near-equal fill by Karmarkar-Karp multiway differencing.

``pieces`` cuts each document into whole windows and a rest of short pieces.
``pack`` deals the pieces at random into groups of bounded size (so that a hot
source, a group of copies or one huge document spreads like all others), and
each group is partitioned by itself: partial partitions with the largest
spreads are merged, the fullest window of one with the emptiest of the other,
until one is left. The number of windows starts at total / capacity and rises
whenever the fullest window exceeds the capacity.

Nulls: a null text is an empty document (the end id alone); a null key is
kept as null. Repeated rows are packed as often as they occur. An empty table
gives an empty result. Other columns of the input are ignored."""

from __future__ import annotations

import heapq
import zlib
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, tokens
from claimwise.llm.ship import ship
from claimwise.llm.words import mix
from claimwise.session import materialize

CAPACITY = 4096
PIECE = 512  # longest piece of a document's last, partial window
GROUP_WINDOWS = 256  # windows in a group, about
GROUP_ROWS = 8192  # pieces in a group at most, about
GROUP_SPAN = 1 << 32  # sequence_id = group * GROUP_SPAN + window


def cut(n: np.ndarray, capacity: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of each piece of documents of ``n`` ids."""
    whole, rest = n // capacity, n % capacity
    count = whole + -(-rest // piece)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    w = whole[doc]
    start = np.where(k < w, k * capacity, w * capacity + (k - w) * piece)
    return doc, start, np.where(k < w, capacity, np.minimum(piece, n[doc] - start))


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
           capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32 (unsigned, over the ids
    as little-endian u32), doc_tokens, salt (for :func:`pack`) and, if asked
    for, the ids themselves."""
    ship(docs.sparkSession)
    path = tokenizer or tokens.default_tokenizer()
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "salt"))])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        made, part = 0, TaskContext.get().partitionId() << 40
        for b in arrow.slices(batches, text):
            ids, n = tokens.tokenizer(path).encode(*arrow.buffers(b.column(text)))
            doc, start, length = cut(n, capacity, piece)
            at = (np.cumsum(n) - n)[doc] + start
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
            salt = mix(np.arange(made, made + len(doc), dtype=np.uint64) + np.uint64(part)) >> np.uint64(1)
            made += len(doc)
            cols = [b.column(key).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc]), pa.array(salt.astype(np.int64))]
            if with_ids:
                cols.append(pa.array([ids[a : a + k].astype(np.int32) for a, k in zip(at.tolist(), length.tolist())], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp partition of ``sizes`` into ``k`` windows: the window of
    each size, and the largest sum. A partial partition is its nonzero sums in
    descending order with the tree node of each; those left out are empty."""
    left, right, tie = [], [], len(sizes)
    heap = [(-int(s), i, np.array([s]), np.array([i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, u = heapq.heappop(heap)
        _, _, b, v = heap[0]
        la, lb = len(a), len(b)
        if la + lb > k:  # a's emptiest windows take b's fullest, and the other way round
            x, y = u[k - lb :], v[k - la :][::-1]
            nodes = np.arange(len(left), len(left) + len(x)) + len(sizes)
            left += x.tolist()
            right += y.tolist()
            sums = np.concatenate([a[: k - lb], a[k - lb :] + b[k - la :][::-1], b[: k - la]])
            node = np.concatenate([u[: k - lb], nodes, v[: k - la]])
        else:
            sums, node = np.concatenate([a, b]), np.concatenate([u, v])
        order = np.argsort(-sums, kind="stable")
        sums, node = sums[order], node[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        tie += 1
        heapq.heapreplace(heap, (-spread, tie, sums, node))
    _, _, sums, node = heap[0]
    window = np.empty(len(sizes) + len(left), np.int64)
    window[node] = np.arange(len(node))
    for i in range(len(left) - 1, -1, -1):  # children come before their parent
        window[left[i]] = window[right[i]] = window[len(sizes) + i]
    return window[: len(sizes)], int(sums[0])


def windows(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size so that no window exceeds ``capacity``."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, most = differencing(sizes, k)
        if most <= capacity:
            return window
        k += 1


def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length", salt: str = "salt",
         order: tuple[str, ...] = ()) -> DataFrame:
    """Add sequence_id and offset to rows of ``length`` at most ``capacity``.
    ``salt`` holds spread non-negative numbers; it deals rows to groups.
    Rows of a sequence follow ``order``."""
    ship(parts.sparkSession)
    size = parts.agg(F.coalesce(F.sum(length), F.lit(0)), F.count(F.lit(1))).first()
    groups = max(1, -(-size[0] // (capacity * GROUP_WINDOWS)), -(-size[1] // GROUP_ROWS))
    out = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(keys: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf[length].to_numpy()
        window = np.empty(len(sizes), np.int64)
        full = sizes >= capacity
        window[full] = np.arange(int(full.sum()))
        if not full.all():
            window[~full] = int(full.sum()) + windows(sizes[~full], capacity)
        pdf = pdf.assign(sequence_id=int(keys[0]) * GROUP_SPAN + window)
        pdf = pdf.sort_values(["sequence_id", *order, salt], kind="stable")
        return pdf.assign(offset=pdf.groupby("sequence_id")[length].cumsum() - pdf[length])[out.names]

    return parts.groupBy(F.pmod(F.col(salt), F.lit(groups))).applyInPandas(one, out)


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                   capacity: int = CAPACITY, piece: int = PIECE, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset."""
    parts = materialize(pieces(docs, key, text, tokenizer, capacity, piece, with_ids))
    return pack(parts, capacity, order=(key, "start")).drop("salt")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Whole training sequences of pieces packed ``with_ids``: sequence_id, ids,
    and per piece its document and length (for attention masks)."""
    part = F.struct("offset", F.col(key).alias("doc"), "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.col("p.doc").alias("docs"), F.col("p.length").alias("lengths"))
