"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage but the last returns the columns of ``documents``. It has no SQL
twin, since the classifier is a trained model; tests/llm/test_pipeline.py holds
each stage against a brute-force version of it.

Nulls, empty and repeated rows and very long texts are handled as each operator's
docstring says. Columns beyond those of ``documents``, whatever their names and
types, go through all stages but the last unchanged. A document is dropped if the classifier rejects it, if another document of its
similarity class stays, if all its words are repeats of earlier ones, or if it
lies beyond its leaf's token-prefix in the mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.llm import classifier, jaccard, mixing, packing, registry, substrings
from claimwise.session import materialize

#: The mix takes this share of all words, each document at most once.
SHARE, EPOCHS = 0.8, 1


#: Columns that stages use; all others go through them unchanged.
USED = ("doc_id", "text", "lang", "source", "n_chars")


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the columns that no stage uses under names that no operator
    uses either, and those names' own."""
    names = {c: f"_carried{i}" for i, c in enumerate(docs.columns) if c not in USED}
    return docs.withColumnsRenamed(names), {v: k for k, v in names.items()}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    return classifier.keep_good(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")).withColumnsRenamed(names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    return jaccard.deduplicate(rows).withColumnsRenamed(names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, names = _aside(docs)
    rows = substrings.remove_repeats(rows, carry=("lang", "source", *names))
    rows = rows.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).drop("n_words", "n_removed", "kept_sha256")
    return rows.withColumnsRenamed(names).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    levels = registry.MIX_LEVELS
    rows, names = _aside(docs)
    rows = rows.withColumn("domain", registry.domain("source"))
    _, plan = mixing.plan_mix(rows, levels, registry.MIX_WEIGHTS, share=SHARE, max_epochs=EPOCHS, seed=registry.MIX_SEED)
    rows = mixing.select_mix(rows, plan, levels, seed=registry.MIX_SEED).drop("domain", "epoch")
    return rows.withColumnsRenamed(names).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
