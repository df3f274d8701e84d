"""One key holding a third of all rows: still exact, still split."""

import statistics

from pyspark.sql import functions as F

from claimwise.operators.ranking import group_median, ntile


def _data(spark):
    # 30,000 rows; group "hot" has 10,000 rows that all carry the same value
    return spark.range(30000).select(
        F.when(F.col("id") < 10000, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("g"),
        F.when(F.col("id") < 10000, F.lit(5)).otherwise((F.col("id") * 7919) % 1000).cast("long").alias("v"),
        F.col("id").cast("string").alias("row_id"),
    )


def test_median_exact_under_skew(spark):
    df = _data(spark)
    got = dict(group_median(df, ["g"], "v", "m").collect())
    rows = df.collect()
    for g in set(r["g"] for r in rows):
        assert got[g] == statistics.median(r["v"] for r in rows if r["g"] == g)


def test_ntile_with_a_hot_value(spark):
    df = _data(spark)
    b = ntile(df, [F.col("v").desc(), F.col("row_id")], 100, "b", partitions=8)
    sizes = sorted(r["count"] for r in b.groupBy("b").count().collect())
    assert sizes[0] == sizes[-1] == 300
