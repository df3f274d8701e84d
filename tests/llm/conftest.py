import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.fixture
def make_docs(spark):
    """Documents of (doc_id, text), with columns whose names operators use too."""

    def make(rows, extra=()):
        data = [(k, t, "en", "src0", len(t or "")) + tuple("x" for _ in extra) for k, t in rows]
        return spark.createDataFrame(data, DOCS + "".join(f", {c} string" for c in extra))

    return make


#: Names that operators give to columns of their own.
CLASH = ("start", "length", "salt", "node", "class_id", "bands", "host", "lines", "chunk", "cell", "n_words", "score", "epoch", "key")


def random_docs(n, seed, words=60, vocabulary=400):
    """Documents with copies, near copies, shared passages, long and short texts."""
    import random

    r = random.Random(seed)
    vocab = [f"w{i}" + r.choice(["", "", ",", ".", "É"]) for i in range(vocabulary)]
    passage = [r.choice(vocab) for _ in range(45)]
    out = []
    for k in range(n):
        kind = r.random()
        if kind < 0.15 and out:
            t = r.choice(out)[1]
        elif kind < 0.35 and out:
            ws = (r.choice(out)[1] or "x").split(" ")
            for _ in range(max(1, len(ws) // 60)):
                ws[r.randrange(len(ws))] = r.choice(vocab)
            t = " ".join(ws)
        else:
            ws = [r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 19, 20, 21, words, 3 * words]))]
            if r.random() < 0.4:
                at = r.randrange(len(ws) + 1)
                ws[at:at] = passage
            t = r.choice([" ", "  ", "\n", "\t"]).join(ws)
        out.append((k, t))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n ")]
