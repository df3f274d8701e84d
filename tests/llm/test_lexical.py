"""Ranked lexical search against brute force."""

import math
import re

import pytest

from claimwise.llm import lexical

from .conftest import CLASH, random_docs

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"


def terms(t):
    return TERM.findall((t or "").encode().translate(bytes.maketrans(UPPER, LOWER)))


def brute(docs, items, k=10):
    own = [(d, terms(t)) for d, t in docs]
    own = [(d, ws) for d, ws in own if ws]
    n_docs, total = len(own), sum(len(ws) for _, ws in own)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = set()
    for i, ts in wanted.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in ws for _, ws in own) + 1))) for t in ts}
        found = []
        for d, ws in own:
            m = 10 + 90 * len(ws) * n_docs // total
            score = sum(w[t] * (10**9 * tf // (1000 * tf + 8 * m)) for t in ts if (tf := ws.count(t)))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out |= {(i, r + 1, d, -s) for r, (s, _, d) in enumerate(found[:k])}
    return out


def run(spark, docs, items, extra=(), k=10):
    make = lambda rows, key: spark.createDataFrame([(i, t, *["x"] * len(extra)) for i, t in rows], f"{key} long, text string" + "".join(f", {c} string" for c in extra))
    index = lexical.build_index(make(docs, "doc_id").repartition(3))
    rows = lexical.search(index, make(items, "item_id"), k).collect()
    assert len({(r.item_id, r["rank"]) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("segment,run_docs,block,piece,short", [(4 << 20, 1024, 4 << 20, 1 << 20, 16), (900, 2, 300, 7, 3), (4000, 5, 4 << 20, 50, 1)])
def test_search(spark, monkeypatch, segment, run_docs, block, piece, short):
    """Small segments, runs, blocks and pieces give the same as large ones."""
    for name, v in (("SEGMENT_BYTES", segment), ("RUN", run_docs), ("BLOCK_BYTES", block), ("PIECE_BYTES", piece), ("SHORT", short)):
        monkeypatch.setattr(lexical, name, v)
    docs = random_docs(120, 4, words=50, vocabulary=60) + [(None, "w1 w2"), (None, "W1 w2"), (7, "w1, w2! w3"), (7, "w1, w2! w3"), (900, "É w1 É\x00w1\x7fÀ")]
    items = [(0, "w1 w2 w3"), (1, "w5,w5 W6"), (2, None), (3, ""), (4, "nowhere"), (5, "É à " + " ".join(f"w{i}" for i in range(60))), (5, "w59"), (None, "w7 w8")]
    assert run(spark, docs, items, CLASH) == brute(docs, items)


def test_ties_are_by_id_and_long_texts_whole(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 2000)
    docs = [(k, "same words here") for k in range(40, 0, -1)] + [(100, "filler " * 60_000 + "needle"), (101, None), (102, "x")]
    items = [(1, "same"), (2, "needle"), (3, "filler")]
    got = run(spark, docs, items)
    assert got == brute(docs, items)
    assert sorted((r, d) for i, r, d, _ in got if i == 1) == [(k, k) for k in range(1, 11)]


def test_one_document_and_empty_tables(spark):
    assert run(spark, [(1, "only this")], [(1, "this only")], k=3) == brute([(1, "only this")], [(1, "this only")])
    assert run(spark, [], [(1, "x")]) == set()
    assert run(spark, [(1, None), (2, " ,")], [(1, "x")]) == set()
    assert run(spark, [(1, "x")], []) == set()


def test_length_part_beyond_64_bits():
    import numpy as np

    n, docs, total = np.array([3, 10**9]), 10**11, 10**14
    assert lexical._length_part(n, docs, total).tolist() == [10 + 90 * 3 * docs // total, 10 + 90 * 10**9 * docs // total]
