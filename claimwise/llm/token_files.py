"""Token-id files: word-aligned Simple-8b shards, written and read by Spark tasks.

A shard holds the documents of one range of keys in ascending order:

    words      u64 little-endian code words of all blocks, one after another
    offsets    u64 x (blocks + 1): first word of each block
    ends       u64 x documents: ids up to each document's end
    keys       i64 x documents, then u8 x documents: 1 where the key is null
    footer     magic, then u64: block size, ids, blocks, documents

A block codes ``BLOCK`` ids (the last may have fewer). A code word's upper 4
bits select how many ids of how many bits its lower 60 bits pack, lowest bits
first; the escape selector says that the next word is one raw id. Blocks stand
alone, so many are coded and decoded side by side in numpy.

Shards lie below ``spark.checkpoint.dir`` or a given folder that all executors
share. A task writes to a name of its own and then renames, so a repeated task
leaves whole files only; the manifest, written by Spark's own commit, names
the ones that count."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, tokens
from claimwise.llm.ship import ship
from claimwise.session import ensure_checkpoint_dir, materialize

BLOCK = 1024  # ids in a block
READ_BLOCKS = 1024  # blocks decoded at once
MAGIC = b"S8BIDS01"
# Fixed values of the format: (ids, bits of each) by selector; selector 15 is the escape.
SELECTORS = [(240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
WIDEST = SELECTORS[0][0]
CHUNK = 256  # blocks coded at once
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("shard", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType())])


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(code words, words of each block). Each word takes as many ids as any
    selector can. What fits is found for all places at once, then all blocks
    step through their words together, and last the words of each selector
    are packed together."""
    parts = [_encode(ids[k : k + CHUNK * block], block) for k in range(0, len(ids), CHUNK * block)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([w for w, _ in parts]), np.concatenate([c for _, c in parts])


def _encode(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    rows, last = -(-len(ids) // block), len(SELECTORS) - 1
    kind = np.uint32 if int(ids.max()) < 1 << 32 else np.uint64
    grid = np.zeros((rows, block + WIDEST), kind)  # what lies beyond the block reads as zeros
    full = len(ids) // block
    grid[:full, :block] = ids[: full * block].reshape(full, block)
    size = np.full(rows, block)
    if full < rows:
        grid[full, : len(ids) - full * block] = ids[full * block :]
        size[full] = len(ids) - full * block
    choice = np.full((rows, block), last, np.uint8)
    if kind is np.uint64:
        choice += grid[:, :block] >> np.uint64(60) > 0  # the escape
    most, have = grid, 1  # largest of the next ``have`` ids
    for count, bits in reversed(SELECTORS[:-1]):
        while have < count:
            step = min(have, count - have)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            have += step
        fits = most[:, :block] < kind(min(1 << bits, np.iinfo(kind).max))
        if not fits.any():
            break  # more ids of fewer bits do not fit either
        choice -= fits  # all selectors with fewer ids fit too
    counts = np.array([c for c, _ in SELECTORS] + [1])
    at, lane, out_row, out_at, out_sel = np.zeros(rows, np.int64), np.arange(rows), [], [], []
    while len(lane):
        here = at[lane]
        sel = choice[lane, here]
        out_row.append(lane)
        out_at.append(here)
        out_sel.append(sel)
        at[lane] = here = here + counts[sel]
        if here.max() >= block or rows != full:
            lane = lane[here < size[lane]]
    row, here, sel = np.concatenate(out_row), np.concatenate(out_at), np.concatenate(out_sel)
    order = np.argsort(row, kind="stable")
    row, here, sel = row[order], here[order], sel[order]
    word, flat, base = sel.astype(np.uint64) << np.uint64(60), grid.ravel(), row * grid.shape[1] + here
    for s in np.unique(sel).tolist():
        if s < ESCAPE and SELECTORS[s][1]:
            m = np.flatnonzero(sel == s)
            i, w = base[m], word[m]
            for j in range(SELECTORS[s][0]):
                w |= flat[i + j].astype(np.uint64) << np.uint64(j * SELECTORS[s][1])
            word[m] = w
    per_block = np.bincount(row, minlength=rows)
    if (sel == ESCAPE).any():
        raw = np.flatnonzero(sel == ESCAPE)
        word = np.insert(word, raw + 1, flat[base[raw]])
        per_block += np.bincount(row[raw], minlength=rows)
    return word, per_block


def decode_blocks(words: np.ndarray, per_block: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of whole blocks coded by :func:`encode_blocks`."""
    rows = len(per_block)
    first = np.cumsum(per_block) - per_block
    sel = (words >> np.uint64(60)).astype(np.int64)
    row = np.repeat(np.arange(rows), per_block)
    raw = np.zeros(len(words), bool)
    for r in np.unique(row[sel == ESCAPE]).tolist():  # few: find the raw words of blocks that may hold one
        k, stop = int(first[r]), int(first[r] + per_block[r])
        while k < stop:
            raw[k + 1 : k + 2] = sel[k] == ESCAPE
            k += 1 + int(sel[k] == ESCAPE)
    count = np.array([c for c, _ in SELECTORS] + [0])[sel]
    count[raw] = 1
    before = np.cumsum(count) - count
    base = before - np.repeat(before[first] if rows else before[:0], per_block) + row * (block + WIDEST)
    out = np.zeros(rows * (block + WIDEST), np.uint64)
    sel[raw] = -1
    for s, (c, bits) in enumerate(SELECTORS):
        m = np.flatnonzero(sel == s) if bits else ()
        if len(m):
            w, i = words[m], base[m]
            for j in range(c):
                out[i + j] = (w >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    out[base[raw]] = words[raw]
    return out.reshape(rows, block + WIDEST)[:, :block].ravel()[:n]


class ShardWriter:
    """Appends documents to one shard; blocks go out as they fill."""

    def __init__(self, sink: Any):
        self.sink, self.rest = sink, np.zeros(0, np.uint64)
        self.blocks, self.ends, self.keys, self.nulls, self.ids = [], [], [], [], 0

    def add(self, keys: np.ndarray, nulls: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.nulls.append(nulls.astype(np.uint8))
        self.ends.append((self.ids + np.cumsum(n)).astype("<u8"))
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids.astype(np.uint64)])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        words, per_block = encode_blocks(ids)
        self.sink.write(words.astype("<u8").tobytes())
        self.blocks.append(per_block)

    def close(self) -> tuple[int, int]:
        self._put(self.rest)
        blocks = np.concatenate(self.blocks)
        docs = sum(map(len, self.keys))
        self.sink.write(np.concatenate([[0], np.cumsum(blocks)]).astype("<u8").tobytes())
        for part in (self.ends, self.keys, self.nulls):
            for x in part:
                self.sink.write(x.tobytes())
        self.sink.write(MAGIC + np.array([BLOCK, self.ids, len(blocks), docs], "<u8").tobytes())
        return docs, self.ids


def read_shard(source: Any) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, nulls, ids, ids per document) of a shard (a random access file),
    some documents at a time; one document's ids are held whole."""
    size = source.size()
    source.seek(size - 40)
    foot = source.read(40)
    if foot[:8] != MAGIC:
        raise ValueError("not a token-id shard, or cut short")
    block, n, blocks, docs = (int(x) for x in np.frombuffer(foot, "<u8", offset=8))
    tail = size - 40 - docs * 17 - 8 * (blocks + 1)
    source.seek(tail)
    offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<u8").astype(np.int64)
    ends = np.frombuffer(source.read(8 * docs), "<u8").astype(np.int64)
    keys = np.frombuffer(source.read(8 * docs), "<i8")
    nulls = np.frombuffer(source.read(docs), np.uint8).astype(bool)
    held, done, at = np.zeros(0, np.uint32), 0, 0  # ids read but not given out, documents and ids given out
    for b in range(0, blocks, READ_BLOCKS):
        e = min(blocks, b + READ_BLOCKS)
        source.seek(8 * int(offsets[b]))
        words = np.frombuffer(source.read(8 * int(offsets[e] - offsets[b])), "<u8")
        ids = decode_blocks(words, np.diff(offsets[b : e + 1]), min(n, e * block) - b * block, block)
        held = np.concatenate([held, ids.astype(np.uint32 if not len(ids) or int(ids.max()) < 1 << 32 else np.uint64)])
        upto = int(np.searchsorted(ends, at + len(held), "right"))
        if upto > done:
            stop = int(ends[upto - 1])
            yield keys[done:upto], nulls[done:upto], held[: stop - at], np.diff(ends[done:upto], prepend=at)
            held, done, at = held[stop - at :], upto, stop
    if done < docs:  # documents without ids at the end
        yield keys[done:], nulls[done:], held, np.diff(ends[done:], prepend=at)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                      folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Write shards in ascending key order (nulls first) and return the manifest:
    path, shard (its place in the order), docs, ids. Rows with one key are
    ordered as they lie in the input, and may spread over shards."""
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or tokens.default_tokenizer()
    folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}").rstrip("/")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        task, sink = TaskContext.get(), None
        fs, base = open_folder(folder)
        final = f"{base}/shard-{task.partitionId():06d}-{uuid.uuid4().hex[:8]}.s8b"
        for b in arrow.slices(batches, text):
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{final}.part")
                shard = ShardWriter(sink)
            ids, n = tokens.tokenizer(path).encode(*arrow.buffers(b.column(text)))
            k = b.column(key)
            shard.add(k.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(k.is_null()), ids, n)
        if sink is not None:
            n_docs, n_ids = shard.close()
            sink.close()
            fs.move(f"{final}.part", final)
            yield pa.RecordBatch.from_pylist([{"path": final, "shard": task.partitionId(), "docs": n_docs, "ids": n_ids}], schema=pa.schema([("path", pa.string()), ("shard", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    keyed = docs.select(F.col(key).cast("long").alias(key), text).withColumn("_row", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(shards, key, "_row").sortWithinPartitions(key, "_row")
    manifest = materialize(ranged.drop("_row").mapInArrow(run, MANIFEST))
    return manifest.withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Read shards back: per document key, start (ids of all documents before
    it), n_tokens and the unsigned crc32 of its ids as little-endian u32."""
    spark: SparkSession = manifest.sparkSession
    ship(spark)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    placed = placed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "shard")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (key, "start", "n_tokens", "ids_crc32")])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                fs, _ = open_folder(r["folder"])
                at = r["before"]
                with fs.open_input_file(r["path"]) as source:
                    for keys, nulls, ids, n in read_shard(source):
                        ends = np.cumsum(n)
                        view = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                        cols = [pa.array(keys, pa.int64(), mask=nulls), pa.array(at + ends - n), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
                        at += int(n.sum())
                        yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return placed.mapInArrow(run, schema)
