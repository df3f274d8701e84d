"""Neighbours, classifier and language model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimwise.llm import classifier, language_model, neighbours, registry, words

from .conftest import CLASH, SF, random_docs


def nearest(rows, k):
    """Exact: {query id: [(id, score)]}."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    return {i: sorted(((j, float(v @ w)) for j, w in ok if j != i), key=lambda x: (-round(x[1], 9), x[0]))[:k] for i, v in ok if i % 20 == 0}


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
        assert len(out[r.query_id]) == r["rank"]
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<float>, label int, node int, score int")


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-4, 5, 6).astype(float).tolist()) for i in range(1, 200)]
    rows += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200, 300)]  # one hot vector, many ties
    rows += [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] * 6), (380, [float("inf")] * 6), (400, [1.0]), (None, [1.0] * 6)]
    rows += [rows[5]]
    got = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0))
    want = nearest([r for r in rows[:-1] if r[0] != 400], 20)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-12)


@pytest.mark.parametrize("repeats", [3, 50])
def test_repeated_rows_of_a_hot_vector_count_once(spark, repeats):
    """The class keeps its k + 1 smallest ids however often their rows repeat."""
    rng = np.random.default_rng(4)
    hot = [(i, [1.0, 2.0, 0.0, 1.0]) for i in range(1, 41)]
    rows = [(i, rng.integers(-2, 2, 4).astype(float).tolist()) for i in range(41, 120)]
    got = found(neighbours.search(table(spark, hot * repeats + hot[:1] * 500 + rows).repartition(7), F.col("vec_id") % 20 == 0))
    want = nearest(hot + rows, 20)
    assert set(got) == set(want) and [i for i, _ in want[20]][:20] == [*range(1, 20), 21]
    assert {q: [i for i, _ in got[q]] for q in want} == {q: [i for i, _ in want[q]] for q in want}


def test_each_length_is_searched_by_itself(spark):
    rng = np.random.default_rng(6)
    make = lambda ids, n: [(i, rng.integers(-4, 5, n).astype(float).tolist()) for i in ids]
    short, long = make(range(1, 60), 3), make(range(60, 130), 5)
    got = found(neighbours.search(table(spark, short + long + [(200, [1.0])]), F.col("vec_id") % 20 == 0))
    want = nearest(short, 20) | nearest(long, 20)
    assert {q: [i for i, _ in got[q]] for q in got} == {q: [i for i, _ in want[q]] for q in want}


def test_neighbours_over_segments(spark):
    """Small segments and a narrow window still reach the recall."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.2 * rng.normal(size=16)).tolist()) for i in range(3000)]
    got = found(neighbours.search(table(spark, rows), F.col("vec_id") % 20 == 0, segment=128))
    rows = [(i, np.array(v, np.float32).tolist()) for i, v in rows]
    want = nearest(rows, 20)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


def test_few_and_no_vectors(spark):
    got = found(neighbours.search(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]), F.col("vec_id") % 20 == 0))
    assert got == {0: [(1, 0.5), (20, 0.0)], 20: [(1, 0.5), (0, 0.0)]}
    assert neighbours.search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.search(table(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0


def test_query_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = found(registry.op3_neighbours(spark, SF)), nearest(rows, 20)
    assert set(got) == set(want)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_walks_the_grid(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = neighbours.hilbert(grid, bits)
    walk = grid[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(len(grid))) and (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_classifier_on_held_out_rows(spark):
    rows = registry.op7_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good])
    assert auc > 0.95 and np.mean([(s >= 0.5) == y for s, y in held]) > 0.93


def plain_terms(text):
    """[(place of the word, place of its shape)], one word at a time."""
    def place(b):
        return int(words.hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) * classifier.TERMS >> 64

    def shape(b):
        return b"".join(re.findall(rb"(?s)(.)(?!\1)", re.sub(rb"[0-9]", b"9", re.sub(rb"[a-z\x80-\xff]", b"x", re.sub(rb"[A-Z]", b"X", b)))))

    return [(place(w), place(shape(w)) + classifier.TERMS) for w in (text or "").encode().split()]


def plain_vectors(texts):
    sums = np.zeros((2 * classifier.TERMS, classifier.DIM))
    for t in texts:
        found = plain_terms(t)
        for one, two in zip(found, found[1:]):
            for mine, other in [(one, two), (two, one)]:
                for m in mine:
                    for o in other:
                        for d, sign in zip(classifier.INDEX_DIM[o], classifier.INDEX_SIGN[o]):
                            sums[m, d] += sign
    size = np.sqrt((sums * sums).sum(1))
    return sums / np.where(size > 0, size, 1)[:, None]


def plain_features(text, vectors):
    found = plain_terms(text)
    if not found:
        return [0.0] * classifier.FEATURES
    out, n = [], len(found)
    for a in range(2):
        v = [vectors[t[a]] for t in found]
        out += [sum(x[d] for x in v) / n for d in range(classifier.DIM)]
        out += [sum(x[d] ** 2 for x in v) / n for d in range(classifier.DIM)]
    for a in range(2):
        out.append(sum(float(vectors[x[a]] @ vectors[y[a]]) for x, y in zip(found, found[1:])) / n)
    return [*out, sum(x[0] == y[0] for x, y in zip(found, found[1:])) / n, math.log(1 + n)]


def test_word_vectors_and_pooling_word_by_word(spark, make_docs):
    """Vectors summed over tasks, features and scores against plain loops."""
    docs = [(k, t) for k, t in random_docs(60, 12)] + [(800, "Then, THE Éa 12a a1 w1 w1"), (801, None), (802, ""), (803, "one"), (803, "one")]
    vectors = classifier.context_vectors(make_docs(docs, CLASH).repartition(5))
    want = plain_vectors([t for _, t in docs])
    assert np.abs(want).sum() > 0 and np.allclose(vectors, want, atol=1e-6)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, classifier.FEATURES))
    net = classifier.fit(x, (x[:, 0] > 0).astype(float), np.arange(80) % 5 == 0)
    rows = classifier.features(make_docs(docs, CLASH).repartition(3), vectors).collect()
    texts = {k: t for k, t in docs}
    assert len(rows) == len(docs)
    for r in rows:
        got, plain = np.frombuffer(r.features, "<f4"), np.array(plain_features(texts[r.doc_id], want))
        assert np.allclose(got, plain, atol=1e-5)
        hidden = [math.tanh(sum((f - m) / s * w for f, m, s, w in zip(got, net.mean, net.scale, col)) + b) for col, b in zip(net.w1.T, net.b1)]
        logit = (sum(h * w for h, w in zip(hidden, net.w2)) + net.b2) / net.temperature
        assert net.score(got[None])[0] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, logit)))), abs=1e-6)


def peak_mb(f, *args):
    import tracemalloc

    tracemalloc.start()
    try:
        f(*args)
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("documents", [1, 1000])
def test_classifier_worker_memory(documents):
    """Word vectors of a whole slice are never held at once, in one long document or many."""
    word = np.random.default_rng(4).choice(list("abcdefghij"), 300_000)
    raw = np.frombuffer(" ".join(word).encode() + b" ", np.uint8)
    offsets = np.linspace(0, len(raw), documents + 1).astype(np.int64)
    vectors, sums = np.ones((2 * classifier.TERMS, classifier.DIM), np.float32), np.zeros(2 * classifier.TERMS * classifier.DIM)
    t, first = classifier.terms(offsets, raw)  # tables of powers are made here
    assert len(t) == 300_000
    assert peak_mb(classifier.pool, offsets, raw, vectors) < 60
    assert peak_mb(classifier._add_contexts, sums, t, first) < 8


def test_classifier_parts_do_not_matter(monkeypatch):
    docs = [(t or "").encode() for _, t in random_docs(60, 12)] + [b"one", b"", "Then, THE \u00c9a 12a a1 w1 w1".encode()]
    raw, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    out = []
    for part in (1, 7, 1 << 30):
        monkeypatch.setattr(classifier, "PART", part)
        sums = np.zeros(2 * classifier.TERMS * classifier.DIM)
        classifier._add_contexts(sums, *classifier.terms(offsets, raw))
        out.append((sums.tobytes(), classifier.pool(offsets, raw, sums.reshape(-1, classifier.DIM).astype(np.float32)).tobytes()))
    assert len(set(out)) == 1


def test_classifier_odd_rows(spark, make_docs):
    docs = make_docs([(1, "Good text here."), (2, None), (3, ""), (3, ""), (None, "x " * 50_000)], CLASH)
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in classifier.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (77, 1), (None, 0)], "doc_id long, quality int")
    rows = classifier.classify(docs, one).collect()
    assert len(rows) == 5 and all(r.predicted == 1 for r in rows)
    assert classifier.keep_good(docs, one).columns == docs.columns
    assert classifier.classify(make_docs([]), one).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(classifier.fold("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in classifier.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def tokens_of(t):
    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    return [w.translate(low) for w in (t or "").encode().split()] + ["end"]


def brute_model(rows, order=2):
    """(scores of a text, P(word | context), word counts), each n-gram in dictionaries."""
    train = [t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2]
    uni, grams = Counter(), [Counter() for _ in range(order + 1)]
    for t in train:
        ws = ["end"] * (order - 1) + tokens_of(t)
        uni.update(ws[order - 1 :])
        for i in range(order - 1, len(ws)):
            for k in range(1, order + 1):
                grams[k][tuple(ws[i - k + 1 : i + 1])] += 1
    for k in range(1, order):  # below the highest order: how many words come before
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    n, v = sum(uni.values()), len(uni)
    counts = lambda c: [sum(1 for x in c.values() if x == k) for k in (1, 2, 3, 4)]
    d = [language_model.discounts(counts(c)) for c in grams]
    total, freed = defaultdict(int), defaultdict(float)
    for k in range(1, order + 1):
        for g, c in grams[k].items():
            total[k, g[:-1]] += c
            freed[k, g[:-1]] += d[k][min(c, 3) - 1]

    def p(context, w):
        k = len(context) + 1
        lower = p(context[1:], w) if context else 1 / (v + 1)
        if not total[k, context]:
            return lower
        c = grams[k][context + (w,)]
        return (max(0, c - d[k][min(c, 3) - 1]) if c else 0) / total[k, context] + freed[k, context] / total[k, context] * lower

    def score(t):
        ws = tokens_of(t)
        padded = ["end"] * (order - 1) + ws
        model = sum(math.log10(p(tuple(padded[i : i + order - 1]), w)) for i, w in enumerate(ws))
        return (len(ws), sum(uni[w] > 0 for w in ws), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in ws), model)

    return score, p, uni


@pytest.mark.parametrize("order,pairs", [(2, 1 << 64), (2, 1), (3, 1 << 64), (3, 1), (5, 1 << 64), (5, 5000)])
def test_language_model(spark, make_docs, monkeypatch, order, pairs):
    """Also with keys that are hashes (more than ``pairs`` pairs of ids)."""
    monkeypatch.setattr(language_model, "HELD", 200)
    monkeypatch.setattr(language_model, "PAIRS", pairs)
    rows = random_docs(150, 9) + [(None, "W1 w1 É é"), (7, "w1 w2"), (7, "w1 w2"), (8, "w1 w2 w3 " * 9000)]
    got = language_model.train_and_score(make_docs(rows, CLASH).repartition(3), order=order).collect()
    score, p, uni = brute_model(rows, order)
    for context in [("end",) * (order - 1), ("w1",) * (order - 1)]:
        assert abs(sum(p(context, w) for w in uni) + p(context, "never") - 1) < 1e-9
    want = sorted((k or -1, *score(t)) for k, t in rows)
    for g, w in zip(sorted((g.doc_id or -1, g.n_tokens, g.n_known, g.train_tokens, g.base_score, g.score) for g in got), want):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def test_counts_are_as_wide_as_needed():
    for high in (0, 255, 256, 65_535, 65_536, 2**32 - 1, 2**32, 2**63):
        a = np.array([0, high], np.uint64)
        assert (language_model._narrow(a) == a).all()
    assert [language_model._narrow(np.array([x], np.uint64)).itemsize for x in (255, 256, 65_536, 2**32)] == [1, 2, 4, 8]


def test_query_op9(spark):
    """The registered query against a model in dictionaries."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    score, _, _ = brute_model(rows)
    got = {r.doc_id: r for r in registry.op9_lm_scoring(spark, SF).collect()}
    assert len(got) == len(rows)
    for k, t in rows:
        g, w = got[k], score(t)
        assert g.held_out == (zlib.crc32(str(k).encode()) % 7 == 2) and (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert (g.base_score, g.score) == pytest.approx(w[3:], rel=1e-9)


def test_order_must_be_two_or_more(make_docs):
    with pytest.raises(ValueError):
        language_model.train(make_docs([(1, "a")]), order=1)


def test_language_model_without_training_rows(spark, make_docs):
    held = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = language_model.train_and_score(make_docs([(k, "a b") for k in held])).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == 0 and r.base_score == 0 for r in rows)
    assert language_model.train_and_score(make_docs([])).count() == 0
