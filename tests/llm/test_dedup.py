"""Substring dedup and Jaccard join against brute force."""

import hashlib
import random

import pytest

from claimwise.llm import jaccard, substrings

from .conftest import CLASH, random_docs


def words_of(t):
    return [w.decode() for w in (t or "").encode().split()]


def brute_repeats(rows, window=20):
    seen, out = set(), {}
    for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ws = words_of(t)
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            s = tuple(ws[i : i + window])
            if s in seen:
                gone[i : i + window] = [True] * window
            seen.add(s)
        kept = [w for w, g in zip(ws, gone) if not g]
        out[k] = (len(ws), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed,chunk", [(1, 1 << 20), (2, 300), (3, 2000)])
def test_repeats(spark, make_docs, monkeypatch, seed, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    rows = random_docs(90, seed)
    r = random.Random(seed)
    rows += [(500, "a " * 70), (501, "a b " * 60), (502, " ".join(r.choice("ab") for _ in range(400)))]
    r.shuffle(rows)
    got = substrings.remove_repeats(make_docs(rows, CLASH).repartition(3), carry=("lang", "n_chars")).collect()
    want = brute_repeats(rows)
    assert len(got) == len(rows)
    for g in got:
        n, lost, sha, kept = want[g.doc_id]
        assert (g.n_words, g.n_removed, g.kept_sha256) == (n, lost, sha)
        assert words_of(g.text) == kept and g.lang == "en"


def test_repeats_null_and_repeated_keys_and_empty(spark, make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    got = substrings.remove_repeats(make_docs([(4, text), (None, text), (4, text)])).collect()
    assert sorted((g.doc_id is not None, g.n_removed) for g in got) == [(False, 0), (True, 25), (True, 25)]
    assert substrings.remove_repeats(make_docs([])).count() == 0


def test_cover_meets_every_shift():
    for s in range(substrings.PERIOD):
        assert any((c + s) % substrings.PERIOD in substrings.COVER for c in substrings.COVER)


def grams(t, n=5):
    ws = words_of(t)
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


def brute_join(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    classes = {}
    for i, (k, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(k)
    return {k: (min(classes[find(i)]), links[i], len(sets[i])) for i, (k, _) in enumerate(rows)}


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3)])
def test_join(spark, make_docs, monkeypatch, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rows = random_docs(120, seed)
    got = jaccard.jaccard_join(make_docs(rows, CLASH).repartition(3)).collect()
    want = brute_join(rows)
    assert {g.doc_id: (g.class_id, g.n_links, g.n_grams) for g in got} == want
    assert sorted(g.doc_id for g in got if g.keep) == sorted({c for c, _, _ in want.values()})


def test_hot_group_of_near_copies(spark, make_docs, monkeypatch):
    """All links of a large group are counted, over several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 20)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(90):
        ws = list(base)
        ws[k % 50] = f"new{k % 30}"
        rows.append((k, " ".join(ws)))
    got = {g.doc_id: (g.class_id, g.n_links, g.n_grams) for g in jaccard.jaccard_join(make_docs(rows)).collect()}
    assert got == brute_join(rows) and all(c == 0 and n == 89 for c, n, _ in got.values())


def test_join_repeated_rows_null_keys_and_empty(spark, make_docs):
    text = "one two three four five six"
    docs = make_docs([(5, text), (5, text), (None, text), (6, "a b"), (7, "a b"), (8, None), (9, "")])
    got = sorted(((g.doc_id or 0, g.class_id, g.n_links, g.keep) for g in jaccard.jaccard_join(docs).collect()), key=repr)
    assert [g[:3] for g in got] == [(0, 5, 2), (5, 5, 2), (5, 5, 2), (6, 6, 1), (7, 6, 1), (8, 8, 0), (9, 9, 0)]
    assert sum(g[3] for g in got) == 4
    assert sorted(r.doc_id for r in jaccard.deduplicate(docs).collect()) == [5, 6, 8, 9]
    assert jaccard.jaccard_join(make_docs([])).count() == 0


def test_bands_reach_the_recall():
    for t in (0.5, 0.8, 0.9, 1.0):
        bands, rows = jaccard.choose_bands(t, 0.999)
        assert 1 - (1 - t**rows) ** bands >= 0.999 and bands * rows <= jaccard.HASHES


def test_very_long_texts(spark, make_docs):
    """Whole texts of 40,000 words count, to their last word."""
    r = random.Random(7)
    long = [f"w{r.randrange(10**6)}" for _ in range(40_000)]
    near, far = list(long), [f"v{r.randrange(10**6)}" for _ in range(40_000)]
    near[100] = near[-1] = "other"
    far[-30:] = long[-30:]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(far)), (4, "x" * 400_000), (5, "a short text")]
    got = {g.doc_id: (g.class_id, g.n_links, g.n_grams) for g in jaccard.jaccard_join(make_docs(rows)).collect()}
    assert got == brute_join(rows) and got[2][:2] == (1, 1) and got[3][:2] == (3, 0)
    want = brute_repeats(rows)
    for g in substrings.remove_repeats(make_docs(rows)).collect():
        assert (g.n_words, g.n_removed, g.kept_sha256) == want[g.doc_id][:3]
    assert want[3][1] == 30
