"""Merkle manifest against brute force."""

import hashlib
import zlib

import pytest

from claimwise.llm import merkle

from .conftest import CLASH, DOCS


def h(t):
    return hashlib.sha256(t.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    k, text, lang, source, n = row
    return h("".join(map(field, (k, source, lang, n, text))))


def lower(t):
    return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes):
    """(top, per node the list of (left, right) on its way up)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(places):
            run = nodes[p // 16 * 16 :][:16]
            paths[i].append(("".join(run[: p % 16]), "".join(run[p % 16 + 1 :])))
            places[i] = p // 16
        nodes = [h("".join(nodes[a : a + 16])) for a in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *climb([leaf(r) for r in own])))
    root, over = climb([t[1] for t in trees])
    out = []
    for (own, sub, paths), above in zip(trees, over):
        for r, path in zip(own, paths):
            path = path + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            cur = leaf((r[0], lower(r[1]), *r[2:])) if changed else leaf(r)
            for a, b in path:
                cur = h(a + cur + b)
            out.append((r[0], leaf(r), sub, root, h("".join(a + b for a, b in path)), cur, cur == root))
    return sorted(out, key=repr)


def run(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], DOCS + "".join(f", {c} string" for c in extra))
    got = merkle.manifest(df.repartition(3) if rows else df).drop("n_levels").collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"a": 1, None: 3, "é": 300, "Z": 40}, {f"s{i}": 1 + i % 3 for i in range(40)}])
def test_manifest(spark, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((k * 7 % 1009, ["Some Text", "no capitals", None, "", "É und É"][k % 5], [None, "en"][k % 2], s, [None, k][k % 3 > 0]))
            k += 1
    assert run(spark, rows, ("k", "src", "g", "pos", "at", "row", "s0", "path", "digest", "leaf", *CLASH)) == brute(rows)


def test_null_and_repeated_keys_and_long_text(spark):
    rows = [(None, "A", "en", "x", 1), (None, "B", "en", "x", 1), (5, "same", "en", "x", 4), (5, "same", "en", "x", 4), (5, "Other", "en", "x", 5)]
    rows += [(9, "Long " * 200_000, "en", "y", 1)] + [(4, "hot", "en", "x", 3)] * 50
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_tampering_is_seen(spark):
    rows = [(k, "Text" if k % 2 else "text", "en", "x", 4) for k in range(100)]
    for k, _, _, _, _, _, verified in run(spark, rows):
        assert verified == (not (zlib.crc32(str(k).encode()) % 5 == 0 and k % 2))
