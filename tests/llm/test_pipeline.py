"""Each stage of the corpus pipeline against a brute-force version of it."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as P
from claimwise.llm import classifier

from .conftest import SF
from .test_dedup import brute_join, brute_repeats, words_of
from .test_tokens import check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, [[(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]]
    from claimwise.session import materialize

    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns
        assert docs.where(F.col("n_chars") != F.length("text")).count() == 0
        steps.append([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    first, good, one, cut, mixed = steps
    scores = classifier.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    # the stage trains on the same labelled rows
    assert {r[0] for r in good} == {r.doc_id for r in scores.where("predicted = 1").collect()}
    classes = brute_join([(k, t) for k, t, _, _ in good])
    assert {r[0] for r in one} == {c for c, _, _ in classes.values()}
    want = brute_repeats([(k, t) for k, t, _, _ in one])
    assert {k: words_of(t) for k, t, _, _ in cut} == {k: w[3] for k, w in want.items() if w[3] or not w[0]}
    # the mix: a prefix of each leaf in hash order, within a budget of the share of all words
    size, kept = {k: len(words_of(t)) for k, t, _, _ in cut}, {r[0] for r in mixed}
    assert sum(size[k] for k in kept) <= P.SHARE * sum(size.values())
    leaves = Counter((lang, source) for _, _, lang, source in cut)
    for leaf in leaves:
        order = sorted((hashlib.md5(f"17-0-{k}".encode()).hexdigest(), k) for k, _, lang, source in cut if (lang, source) == leaf)
        inside = [k in kept for _, k in order]
        assert inside == sorted(inside, reverse=True)
    packed = P.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(packed, [(k, t) for k, t, _, _ in mixed])


def test_run_and_odd_rows(spark, tmp_path):
    from .conftest import DOCS

    text = " ".join(f"Word{i}, then" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "a b"), (5, text + " more")]
    spark.createDataFrame([(k, t, None if k == 2 else "en", None if k == 1 else "src1", 0) for k, t in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    P.run(spark, str(tmp_path)).collect()
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert P.run(spark, f"{tmp_path}/none").count() == 0


#: Names that operators and stages give to columns of their own, or gave.
ODD = ["extra", "domain", "epoch", "chunk", "key", "_own", "_key", "_hash", "n_words", "n_removed", "kept_sha256", "more", "cells", "docs", "cap", "weight", "tokens",
       "left", "k", "n", "slot", "budget", "level", "given", "epochs", "before", "level0", "_level0", "_epochs", "_cut", "cut", "score", "label", "copy_key", "keep"]


def test_every_column_goes_through(spark):
    """Each stage keeps all columns of the rows it keeps, names of helpers too."""
    from claimwise.session import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    own = F.concat_ws("-", F.col("doc_id"), F.lit("x"))
    docs = materialize(docs.withColumns({c: F.concat(own, F.lit(c)) for c in ODD}).withColumn("list", F.array("doc_id")).withColumn("number", F.col("doc_id") * 1.5))
    for _, stage in P.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF))
        assert after.schema.names == docs.schema.names and after.count() > 0
        kept = after.select("doc_id", "lang", "source", *ODD, F.col("list")[0].alias("one"), "number")
        assert kept.exceptAll(docs.select("doc_id", "lang", "source", *ODD, F.col("list")[0].alias("one"), "number")).count() == 0
        docs = after
    P.STAGES[-1][1](spark, docs, SF).collect()
