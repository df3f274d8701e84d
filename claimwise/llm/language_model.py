"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model of any
order from 2, counted in Spark, stored as sorted hash arrays that workers map into
memory.

Tokens are the words of a text (A-Z in lower case) and an end; ends are also
what comes before a text's first word, as many as the order needs.

1. Words of the training documents are counted. Each range of word hashes becomes a
   file of ascending hashes and one of counts; a word's id is its place in the
   order of all ranges.
2. Order by order, k-grams are counted as pairs (id of the first k - 1 words, id of
   the last word), mixed to an even 64-bit key by a bijection; a k-gram's id is its
   place among the ascending keys of all ranges. If the pairs are too many for 64
   bits, the key is a hash of the pair, like that of a word, and its ids go along.
3. The tasks that merge the k-grams also count how many different words come before
   each (k - 1)-gram. These continuation counts, and the plain counts of the highest
   order, are summed for each context (all, and those met once, twice, and more
   often) into dense arrays by id.

No n-gram is dropped and no count clipped at any size: arrays are as wide as their
largest value needs. Senders combine their counts first, so a
frequent word or n-gram costs one entry per sender, whatever its count. Scoring looks
up each slice's distinct words and n-grams in the arrays in ascending order;
where the folder is not a mounted one they are read part by part instead.

Nulls: a null text is empty (its end is scored); a null key is never held out.
Very long texts are read whole, as a slice of their own. Repeated rows count and score
each time. Without training documents every token has
probability 1 / (V + 1) = 1. An empty table gives an empty result. Other columns
are ignored."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow, words
from claimwise.llm.cells import CELL, by_part, cells, merge, ranged, summed
from claimwise.llm.ship import ship
from claimwise.llm.token_files import open_folder
from claimwise.session import ensure_checkpoint_dir, materialize

END = np.uint64(0x5851F42D4C957F2D)  # any fixed number: the hash of the end of a text
HELD = 2_000_000  # distinct keys that a sender combines before it sends them
PAIRS = 1 << 64  # pairs of ids that are keys themselves; beyond, keys are hashes of them
CONTEXT = ("total", "once", "twice", "more")
MADE = T.StructType([T.StructField("kind", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("sender", T.LongType()), T.StructField("cell", T.BinaryType()), T.StructField("path", T.StringType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))])


def token_hashes(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all tokens of a slice, first token of each document)."""
    w = words.words(offsets, raw, fold_case=True)
    n = len(offsets) - 1
    out = np.empty(len(w.hash) + n, np.uint64)
    ends = w.first[1:] + np.arange(n)
    out[ends] = END
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = w.hash
    return out, w.first + np.arange(n + 1)


class Senders:
    """Distinct keys with summed counts and the ids that go along with each key,
    sent when there are many."""

    def __init__(self, parts: int, most: int):
        self.parts, self.most, self.sender, self.held, self.size = parts, most, TaskContext.get().partitionId() << 33, [], 0

    def add(self, keys: np.ndarray, *ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if ids:
            u, at, n = np.unique(keys, return_index=True, return_counts=True)
        else:
            (u, n), at = np.unique(keys, return_counts=True), None
        self.held.append((u, n, *(c[at] for c in ids)))
        self.size += len(u)
        if self.size > self.most:
            some = self._combine()
            self.held, self.size = [some], len(some[0])
            if self.size > self.most // 2:
                yield self.flush()

    def _combine(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, *cols = (np.concatenate(c) for c in zip(*self.held))
        order = np.argsort(keys, kind="stable")
        return _distinct(keys[order], *(c[order] for c in cols))

    def flush(self) -> pa.RecordBatch:
        keys, *cols = self._combine()
        self.held, self.size = [], 0
        self.sender += 1
        return cells(self.sender, self.parts, keys, *(c.astype(np.uint64) for c in cols))


def _distinct(keys: np.ndarray, n: np.ndarray, *ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct ascending keys, the sums of their counts and their ids."""
    if not len(keys):
        return keys, n, *ids
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(n, start), *(c[start] for c in ids)


@dataclass
class Store:
    """Files of a model: by part, (path, entries). A part's arrays are the files
    ``<path>.<kind>``, of unsigned numbers whose width follows from the file's size.
    With ``span``, parts are even ranges of ids below it, and those without a file
    hold zeros."""

    folder: str
    parts: int
    files: dict[int, tuple[str, int]] = field(default_factory=dict)
    span: int | None = None

    def __post_init__(self) -> None:
        sizes = [self.files.get(p, ("", 0))[1] for p in range(self.parts)]
        self.first = np.concatenate([[0], np.cumsum(sizes)]) if self.span is None else np.array(_bounds(self.span, self.parts))

    def array(self, part: int, kind: str) -> np.ndarray:
        path, n = self.files[part]
        path = f"{path}.{kind}"
        if path not in _mapped:
            fs, _ = open_folder(self.folder)
            if not isinstance(fs, pafs.LocalFileSystem):
                with fs.open_input_file(path) as f:
                    raw = f.read()
                return np.frombuffer(raw, f"<u{len(raw) // n}")
            raw = np.memmap(path, np.uint8, "r")
            _mapped[path] = raw.view(f"<u{len(raw) // n}")
        return _mapped[path]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of ascending ``keys`` in the order of all parts (-1: not there)."""
        out = np.full(len(keys), -1, np.int64)
        for p, a, z in self._ranges(keys, 1 << 64):
            if p in self.files:
                there = self.array(p, "keys")
                at = np.minimum(np.searchsorted(there, keys[a:z]), len(there) - 1)
                out[a:z] = np.where(there[at] == keys[a:z], at + self.first[p], -1)
        return out

    def take(self, places: np.ndarray, kind: str) -> np.ndarray:
        """Values at ascending ``places`` (0 where negative)."""
        out = np.zeros(len(places), np.int64)
        cuts = np.searchsorted(places, self.first)
        for p, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if z > a and p in self.files:
                out[a:z] = self.array(p, kind)[places[a:z] - self.first[p]]
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys in any order, repeated ones too (-1: not there)."""
        at, u = _factor(keys)
        return self.find(u)[at]

    def _ranges(self, keys: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
        bounds = np.array(_bounds(span, self.parts)[1:-1], np.uint64)
        cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
        for p in range(self.parts):
            if cuts[p + 1] > cuts[p]:
                yield p, cuts[p], cuts[p + 1]


_mapped: dict[str, np.ndarray] = {}


def _bounds(span: int, parts: int) -> list[int]:
    return [-(-p * span // parts) for p in range(parts + 1)]


def _narrow(a: np.ndarray) -> np.ndarray:
    """The values in as few bytes as the largest needs."""
    high = int(a.max()) if len(a) else 0
    return a.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if high < 1 << 8 * np.dtype(t).itemsize))


def _save(folder: str, part: int, arrays: dict[str, np.ndarray]) -> str:
    """Write a part's arrays under a name of this attempt's own."""
    fs, base = open_folder(folder)
    fs.create_dir(base, recursive=True)
    path = f"{base}/{part:06d}-{uuid.uuid4().hex[:8]}"
    for kind, a in arrays.items():
        with fs.open_output_stream(f"{path}.{kind}") as out:
            out.write(np.ascontiguousarray(a))
    return path


def _rows(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("sender", pa.int64()), ("cell", pa.binary()), ("path", pa.string()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _store(made: DataFrame, folder: str, parts: int, kind: str, span: int | None = None) -> Store:
    rows = made.where(F.col("kind") == kind).select("part", "path", "n").collect()  # one row a part
    return Store(folder, parts, {r.part: (r.path, r.n) for r in rows}, span)


def _sums(made: DataFrame, kind: str, n: int) -> list[int]:
    return list(made.where(F.col("kind") == kind).agg(*(F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(n))).first())


def _how_often(n: np.ndarray) -> list[int]:
    """Entries counted 1, 2, 3 and 4 times, and more than twice."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n > 2).sum())]


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the
    number of entries counted 1, 2, 3 and 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k / 3 if k < 3 else 0.75
        out.append(min(max(d, 0.05), k - 0.05))
    return out


@dataclass
class Level:
    """The k-grams of one k. Ids of their first k - 1 words are below ``lefts``;
    ``start`` is that of a text's beginning."""

    grams: Store  # keys; the highest order's counts
    words: int
    lefts: int
    start: int
    counts: Store | None = None  # by k-gram id
    contexts: Store | None = None  # by id of the first k - 1 words: total, once, twice, more
    discount: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.wide = self.lefts * self.words > PAIRS  # keys are hashes

    def key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        left, right = left.astype(np.uint64), right.astype(np.uint64)
        if self.wide:
            return words.mix(words.mix(left) * np.uint64(words.MULTIPLIER) + right)
        return words.mix(left * np.uint64(self.words) + right)

    def pair(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(left, right) of keys that are not hashes."""
        left, right = np.divmod(words.unmix(keys), np.uint64(self.words))
        return left.astype(np.int64), right.astype(np.int64)

    def before(self, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The left id of each token, from the (k - 1)-gram that ends at each."""
        left = np.concatenate([[self.start], place[:-1]]) if len(place) else place
        left[first[:-1]] = self.start
        return left

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.full(len(left), -1, np.int64)
        which = np.flatnonzero((left >= 0) & (right >= 0))
        out[which] = self.grams.look_up(self.key(left[which], right[which]))
        return out


@dataclass
class Model:
    vocabulary: Store  # keys: word hashes; counts
    before: Store  # by word id, counts: different words before it
    levels: list[Level]  # of 2-grams and up
    tokens: int  # N
    types: int  # V
    lower: list[float]  # discounts of the words' continuation counts
    lower_left: float  # mass that they leave to the uniform distribution

    @property
    def bigram_types(self) -> int:
        return int(self.levels[0].grams.first[-1])


def train(docs: DataFrame, text: str = "text", folder: str | None = None, order: int = 2) -> Model:
    """Count the documents and store the model of n-grams up to ``order`` below
    ``folder`` (or the shared ``spark.checkpoint.dir``)."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    ship(spark)
    parts, most = int(spark.conf.get("spark.sql.shuffle.partitions")), HELD
    folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}").rstrip("/")

    def word_cells(batches):
        senders = Senders(parts, most)
        for b in arrow.slices(batches, text):
            yield from senders.add(token_hashes(*arrow.buffers(b.column(text)))[0])
        yield senders.flush()

    def words_of(batches):
        for part, group in by_part(batches):
            keys, n, _ = merge(group)
            keys, n = _distinct(keys, n[:, 0])
            path = _save(f"{folder}/words", part, {"keys": keys.astype("<u8"), "counts": _narrow(n)})
            yield _rows([{"kind": "words", "part": part, "path": path, "n": len(keys), "sums": [int(n.sum())]}])

    texts = docs.select(text)
    made = materialize(ranged(texts.mapInArrow(word_cells, CELL), parts).mapInArrow(words_of, MADE))
    vocabulary = _store(made, f"{folder}/words", parts, "words")
    n_tokens, n_types = _sums(made, "words", 1)[0], int(vocabulary.first[-1])
    levels, seen, m = [], n_types, []
    for k in range(2, order + 1):
        start = int(vocabulary.find(np.array([END]))[0]) if k == 2 else seen
        level = Level(Store("", parts), n_types, n_types if k == 2 else seen + 1, start)
        made = _count(texts, text, vocabulary, levels, level, f"{folder}/{k}-grams", parts, last=k == order)
        before, often = _dense(made.where("kind = 'before'"), f"{folder}/{k}-before", ("counts",), seen, parts)
        m.append(often)
        if k > 2:  # what comes before the grams of the order below
            levels[-1].counts = before
            levels[-1].discount = discounts(often[:4])
            sums = _by_context(spark, levels[-1], parts)
            levels[-1].contexts, _ = _dense(sums, f"{folder}/{k - 1}-contexts", CONTEXT, levels[-1].lefts, parts)
        else:
            words_before = before
        level.grams = _store(made, f"{folder}/{k}-grams", parts, "grams")
        seen = int(level.grams.first[-1])
        levels.append(level)
    level.counts, level.discount = level.grams, discounts(_sums(made, "grams", 4))
    level.contexts, _ = _dense(made.where("kind = 'context'"), f"{folder}/{order}-contexts", CONTEXT, level.lefts, parts)
    lower, pairs = discounts(m[0][:4]), int(levels[0].grams.first[-1])
    left = (lower[0] * m[0][0] + lower[1] * m[0][1] + lower[2] * m[0][4]) / pairs if pairs else 1.0
    return Model(vocabulary, words_before, levels, int(n_tokens), n_types, lower, left)


def _count(texts: DataFrame, text: str, vocabulary: Store, lower: list[Level], level: Level, folder: str, parts: int, last: bool) -> DataFrame:
    """The k-grams of ``level`` as files (rows of kind grams), with cells of how
    many come before each (k - 1)-gram and, for the ``last`` level, the counts of each
    context."""
    wide, carry, below, most = level.wide, level.wide or bool(lower), max(1, level.lefts - bool(lower)), HELD

    def gram_cells(batches):
        senders = Senders(parts, most)
        for b in arrow.slices(batches, text):
            h, first = token_hashes(*arrow.buffers(b.column(text)))
            ids = place = vocabulary.look_up(h)
            for lo in lower:
                place = lo.find(lo.before(place, first), ids)
            left = level.before(place, first)
            yield from senders.add(level.key(left, ids), *([left] if wide else []), *([place] if carry else []))
        yield senders.flush()

    def grams_of(batches):
        for part, group in by_part(batches):
            keys, cols, _ = merge(group)
            keys, n, *ids = _distinct(keys, *cols.T)
            left, right = (ids[0], None) if wide else level.pair(keys)
            arrays = {"keys": keys.astype("<u8")} | ({"counts": _narrow(n)} if last else {"left": _narrow(left)} if wide else {})
            yield _rows([{"kind": "grams", "part": part, "path": _save(folder, part, arrays), "n": len(keys), "sums": _how_often(n)}])
            after, before = np.unique(ids[-1] if carry else right, return_counts=True)
            sent = [("before", cells(part, parts, after, before.astype(np.uint64), span=below))]
            if last:
                sent.append(("context", _context_cells(part, parts, left, n, level.lefts)))
            for kind, rows in sent:
                yield _rows([r | {"kind": kind} for r in rows.to_pylist()])

    return materialize(ranged(texts.mapInArrow(gram_cells, CELL), parts).mapInArrow(grams_of, MADE))


def _context_cells(sender: int, parts: int, left: np.ndarray, n: np.ndarray, span: int) -> pa.RecordBatch:
    """Each context's sums (``CONTEXT``) of the counts ``n``."""
    order = np.argsort(left, kind="stable")
    ids, c = summed(left[order], np.stack([n, n == 1, n == 2, n > 2], axis=1).astype(np.int64)[order])
    return cells(sender, parts, ids, *(c[:, i].astype(np.uint64) for i in range(len(CONTEXT))), span=max(1, span))


def _by_context(spark, level: Level, parts: int) -> DataFrame:
    """Cells of each context's sums of continuation counts, part by part."""

    def run(batches):
        for b in batches:
            for part in b.column(0).to_pylist():
                if part in level.grams.files:
                    left = level.grams.array(part, "left").astype(np.int64) if level.wide else level.pair(level.grams.array(part, "keys"))[0]
                    n = level.counts.take(np.arange(*level.grams.first[part : part + 2]), "counts")
                    yield _context_cells(part, parts, left, n, level.lefts)

    return spark.range(0, parts, 1, parts).mapInArrow(run, CELL)


def _dense(sent: DataFrame, folder: str, names: tuple[str, ...], span: int, parts: int) -> tuple[Store, list[int]]:
    """Cells of ids below ``span`` summed into dense arrays ``names``, and how often
    there are which values of the first."""
    bounds = _bounds(span, parts)

    def run(batches):
        for part, group in by_part(batches):
            keys, cols, _ = merge(group)
            keys, cols = summed(keys, cols)
            arrays = {k: np.zeros(bounds[part + 1] - bounds[part], np.uint64) for k in names}
            for i, k in enumerate(names):
                arrays[k][keys.astype(np.int64) - bounds[part]] = cols[:, i]
            path = _save(folder, part, {k: _narrow(a) for k, a in arrays.items()})
            yield _rows([{"kind": "dense", "part": part, "path": path, "n": len(arrays[names[0]]), "sums": _how_often(arrays[names[0]])}])

    made = materialize(ranged(sent.select(*CELL.names), parts).mapInArrow(run, MADE))
    return _store(made, folder, parts, "dense", span), _sums(made, "dense", 5)


def _factor(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each value, distinct ascending values)."""
    code, u = pd.factorize(h)
    order = np.argsort(u, kind="stable")
    rank = np.empty(len(u), np.int64)
    rank[order] = np.arange(len(u))
    return rank[code], u[order]


def _take_off(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(0.0, c - np.array([0.0, *d])[np.minimum(c, 3)])


def log_probabilities(model: Model, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """(log10 probability by the model, base log10, known, first token of each
    document) of the tokens of a slice."""
    h, first = token_hashes(offsets, raw)
    code, u = _factor(h)
    ids = model.vocabulary.find(u)
    count, before = _values(model.vocabulary, ids, "counts"), _values(model.before, ids, "counts")
    base = np.log10((count + 1) / (model.tokens + model.types + 1))
    p = (_take_off(before, model.lower) / max(1, model.bigram_types) + model.lower_left / (model.types + 1))[code]
    seen, ids = (ids >= 0)[code], ids[code]
    place = ids
    for level in model.levels:
        left = level.before(place, first)
        place = level.find(left, ids)
        at, contexts = _factor(left)
        total, *often = (level.contexts.take(contexts, k) for k in CONTEXT)
        d = level.discount
        rest = np.where(total > 0, sum(x * n for x, n in zip(d, often)) / np.maximum(1, total), 1.0)
        p = _take_off(_values(level.counts, place, "counts"), d) / np.maximum(1, total[at]) + rest[at] * p
    return np.log10(p), base[code], seen, first


def _values(store: Store, places: np.ndarray, kind: str) -> np.ndarray:
    """Values at places in any order (0 where negative)."""
    at, u = _factor(places)
    return store.take(u, kind)[at]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns to ``keep``, n_tokens, n_known, train_tokens, base_score,
    score (log10 probability) and perplexity of each document."""
    ship(docs.sparkSession)
    names = [key, *keep]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")] + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score", "perplexity")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, text):
            p, base, known, first = log_probabilities(model, *arrow.buffers(b.column(text)))
            n, start = np.diff(first), first[:-1]  # every document has its end
            total = np.add.reduceat(p, start)
            cols = [n, np.add.reduceat(known.astype(np.int64), start), np.full(len(n), model.tokens), np.add.reduceat(base, start), total, 10 ** np.minimum(300, -total / n)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(c) for c in cols], names=schema.names)

    return docs.select(*names, text).mapInArrow(run, schema)


def held_out(key: str, of: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == fold, F.lit(False))


def train_and_score(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """Train on the documents not held out and score all."""
    rows = docs.select(F.col(key), F.col(text), held_out(key).alias("held_out"))
    return score(rows, train(rows.where("not held_out"), text, order=order), key, text, ("held_out",))
