"""Connected components against union-find."""

import random

from claimwise.llm.components import connected


def test_components(spark):
    r = random.Random(4)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for x in root if find(x) != x}
    got = connected(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {g.node: g.root for g in got} == want and len(got) == len(want)
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
