"""Two-phase removal of duplicates: the hash filters, the rows decide."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimwise.operators import dedup
from claimwise.operators.dedup import drop_exact_duplicates

SCHEMA = "a string, b int, c decimal(18,2), d date"


def rows(n, seed):
    import datetime as dt
    from decimal import Decimal

    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    return [(pick("x", "y", None, "", " x"), pick(1, 2, None), pick(Decimal("1.50"), None), pick(dt.date(2024, 1, 2), None)) for _ in range(n)]


def plain(spark):
    return spark.createDataFrame(rows(400, 1), SCHEMA)


@pytest.mark.parametrize("hash_of", [dedup.row_hash, lambda cols: F.lit(7).cast("long"), lambda cols: F.length(F.coalesce("a", F.lit(""))).cast("long")])
def test_same_as_distinct_whatever_the_hash(spark, hash_of):
    """Also if all rows, or many different ones, share a hash."""
    got = [tuple(r) for r in drop_exact_duplicates(plain(spark), hash_of=hash_of).collect()]
    assert Counter(got) == Counter(set(rows(400, 1)))


def test_some_columns_stored_and_empty(spark):
    df = plain(spark)
    assert drop_exact_duplicates(df, ["a", "b"]).count() == df.select("a", "b").distinct().count()
    assert drop_exact_duplicates(df, stored=True).count() == df.distinct().count()
    assert drop_exact_duplicates(df.limit(0)).count() == 0
    named = df.withColumnRenamed("a", "_row_hash")
    assert drop_exact_duplicates(named).columns == named.columns and drop_exact_duplicates(named).count() == df.distinct().count()


def test_beyond_the_broadcast_bound(spark):
    spark.conf.set("claimwise.broadcastMaxBytes", "0")
    try:
        assert drop_exact_duplicates(plain(spark)).count() == plain(spark).distinct().count()
    finally:
        spark.conf.unset("claimwise.broadcastMaxBytes")


def exchanges(df):
    """(row width in columns) of each shuffle in a plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_single_rows_are_not_shuffled(spark):
    """Only the branch of repeated hashes has a shuffle."""
    df = spark.range(1000).select(F.col("id").cast("string").alias("a"), F.col("id").alias("b"))
    out = drop_exact_duplicates(df)
    assert out.count() == 1000 and len(exchanges(out)) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    single = plan[plan.index("LeftAnti"):]
    assert "Exchange hashpartitioning" not in single[: single.index("LeftSemi")].split("LeftAnti", 1)[0]
