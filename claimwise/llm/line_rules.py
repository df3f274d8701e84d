"""Quality rules: base counts of each text, and cross-document line frequency.

A line's normal form is its words in lower case (A-Z), so white space and case
do not tell lines apart; its hash is taken. For each host the distinct documents
that hold a line are counted, equal texts of a host as one document (copies
are for deduplication to judge) unless ``copies`` counts each of them. A line above
its host's limit is removed: the larger of ``min_docs`` and ``share`` of the host's
distinct documents, the share being at most ``max_docs`` if that is given. A
document that loses more than ``depleted`` of its words is rejected.

A hot host or line is counted in parts before it is shuffled; the lines above
limits are few (each needs more than ``min_docs`` documents), and are broadcast only
after they have been counted.

Nulls: a null text has no words (and fails the base rules); a null host is a
host of its own; a null key is kept. Repeated rows count as one document and are
judged alike. Very long texts and lines are read whole. An empty table gives an empty result. Other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, words
from claimwise.llm.ship import ship
from claimwise.session import materialize

MIN_DOCS = 10  # a line is frequent in more documents of a host than this,
SHARE = 0.005  # and than this share of them
DEPLETED = 0.5  # share of words lost beyond which a document is rejected
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words; per cent of words in repeated windows
BROADCAST_LINES = 500_000  # frequent lines (host and hash) up to which they are broadcast
# The symbols that are counted.
SYMBOLS = "#*$%&|<>"

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in SYMBOLS]] = True
HEAD = (np.arange(256) & 0xC0) != 0x80  # first bytes of code points
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _lines(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of the \\n-split lines of all documents."""
    breaks = np.flatnonzero(raw == 10)
    start = np.concatenate([offsets[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
    order = np.lexsort((start, owner))
    start, owner = start[order], owner[order]
    up = np.append(breaks, np.iinfo(np.int64).max)[np.searchsorted(breaks, start)]  # the next break
    return start, np.minimum(up, offsets[owner + 1]), owner


def _hash_in(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents."""
    with np.errstate(over="ignore"):
        return words.mix(h + words.mix(doc.astype(np.uint64)))


def measure(offsets: np.ndarray, raw: np.ndarray) -> tuple[dict[str, np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Counts per document, and per document the hashes of its distinct
    normalised lines with the words that each has in all its occurrences."""
    w = words.words(offsets, raw)
    doc, n = w.doc, len(offsets) - 1
    out = {"n_words": np.diff(w.first), "word_chars": _per_doc(words.WORD[raw] & HEAD[raw], offsets), "n_symbols": _per_doc(SYMBOL[raw], offsets)}
    start, end, owner = _lines(offsets, raw)
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, owner = start[has_word], end[has_word], owner[has_word]
    again = pd.Series(_hash_in(owner, words.hashes(raw, start, end))).duplicated().to_numpy()
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    h = _hash_in(doc[: max(0, len(w.hash) - 2)], words.ngrams(w.hash, 3))
    inside = np.flatnonzero(words.inside(w.first, 3))
    twice = inside[pd.Series(h[inside]).duplicated(keep=False).to_numpy()]
    cover = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    out["n_repeat_words"] = _per_doc(np.cumsum(cover)[:-1] > 0, w.first)
    # normalised lines: words in lower case with their places
    low = words.hashes(raw, w.start, w.end, fold_case=True)
    first = np.searchsorted(w.start, start)
    size = np.diff(np.append(first, len(w.hash)))
    place = np.arange(len(low)) - np.repeat(first, size)
    with np.errstate(over="ignore"):
        each = words.mix(low + place.astype(np.uint64) * np.uint64(words.MULTIPLIER))
        line = words.mix(np.add.reduceat(each, first)) if len(first) else each
    lines, counts = [], []
    bounds = np.searchsorted(owner, np.arange(n + 1))
    for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        u, back = np.unique(line[a:z], return_inverse=True)
        lines.append(u.view(np.int64))
        counts.append(np.bincount(back, size[a:z], len(u)).astype(np.int64))
    return out, lines, counts


def measured(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """Table of key, host, text_hash, the counts, lines, line_words and node (a
    number of its own for each row)."""
    fields = [T.StructField(key, docs.schema[key].dataType), T.StructField("host", T.StringType()), T.StructField("text_hash", T.LongType())]
    schema = T.StructType(fields + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("lines", "line_words")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, "text"):
            counts, lines, n = measure(*arrow.buffers(b.column("text")))
            cols = [b.column(c) for c in (key, "host", "text_hash")] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(x, pa.list_(pa.int64())) for x in (lines, n)], names=schema.names)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.col(host).cast("string").alias("host"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    return materialize(rows.mapInArrow(run, schema).withColumn("node", F.monotonically_increasing_id()))


def frequent_lines(table: DataFrame, min_docs: int, share: float, max_docs: int | None = None, copies: bool = False, key: str = "doc_id") -> DataFrame:
    """(host, line) above the host's limit."""
    one = table.groupBy("host", "text_hash", *([key] if copies else [])).agg(F.min("node").alias("node"))
    size = one.groupBy("host").agg(F.count(F.lit(1)).alias("docs")).withColumnRenamed("host", "_host")
    lines = table.join(one.select("node"), "node", "left_semi").select("host", F.explode("lines").alias("line"))
    held = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    met = held.join(size, F.col("host").eqNullSafe(F.col("_host")))
    limit = F.col("docs") * F.lit(share)
    limit = limit if max_docs is None else F.least(limit, F.lit(float(max_docs)))
    return materialize(met.where(F.col("n") > limit).select("host", "line", F.col("n").alias("line_docs")))


def quality_rules(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", min_docs: int = MIN_DOCS,
                  share: float = SHARE, depleted: float = DEPLETED, max_docs: int | None = None, copies: bool = False) -> DataFrame:
    """Per document: key, the counts, n_frequent_words (words of its lines above
    limits), base_failed, kept, text_hash and frequent (hashes of those lines,
    for :func:`remove_lines`)."""
    ship(docs.sparkSession)
    table = measured(docs, key, host, text)
    bad = frequent_lines(table, min_docs, share, max_docs, copies, key).withColumnsRenamed({"host": "_host", "line": "_line"})
    few = bad.count() <= BROADCAST_LINES
    lines = table.select("node", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
    lines = lines.select("node", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words"))
    hit = lines.join(F.broadcast(bad) if few else bad, (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host")))
    lost = hit.groupBy("node").agg(F.sum("words").alias("n_frequent_words"), F.collect_list("line").alias("frequent"))
    out = table.drop("lines", "line_words", "host").join(lost, "node", "left").drop("node")
    out = out.withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_frequent_words") <= F.col("n_words") * F.lit(depleted)))


def remove_lines(docs: DataFrame, judged: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The kept documents, their texts without lines above limits."""
    ship(docs.sparkSession)
    use = judged.where("kept").select(F.col(key).alias("_key"), F.col("text_hash").alias("_hash"), F.coalesce("frequent", F.array().cast("array<long>")).alias("_frequent"))
    use = use.dropDuplicates(["_key", "_hash"])
    met = docs.join(use, F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col("_hash")))
    met = met.drop("_key", "_hash")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, text):
            new = [strip(t, set(f)) for t, f in zip(arrow.texts(b.column(text)), b.column("_frequent").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in new]) if c == text else b.column(c) for c in schema.names], names=schema.names)

    return met.mapInArrow(run, schema)


def strip(body: bytes, bad: set[int]) -> bytes:
    """``body`` without the lines whose normal form has a hash in ``bad``."""
    if not bad:
        return body
    parts = body.split(b"\n")
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    _, lines, _ = measure(offsets, np.frombuffer(b"".join(parts), np.uint8))
    return b"\n".join(x for x, h in zip(parts, lines) if not (len(h) and int(h[0]) in bad))
