"""The monthly aggregate on a stream gives the batch answer."""

from pyspark.sql import functions as F

from claimwise.config import DRIVER
from claimwise.sources import tpch
from claimwise.streaming.incremental import monthly_totals, read_claims_stream, start_monthly
from conftest import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    claims = tpch.claims(spark, SF_SMALL, claim_type=False)
    src = str(tmp_path / "landing")
    # the earliest services come last: late claims count
    claims.orderBy(F.desc("service_date")).coalesce(1).write.option("maxRecordsPerFile", 2500).parquet(src)
    latest = {}

    def sink(batch, _epoch):
        # upsert by key: a later micro-batch replaces the day's running totals
        for r in batch.collect():
            latest[r["service_day"]] = r

    q = start_monthly(read_claims_stream(spark, src, claims.schema, max_files_per_trigger=1), sink,
                      str(tmp_path / "ckpt"), DRIVER)
    q.awaitTermination(120)
    per_day = spark.createDataFrame(list(latest.values()), schema=monthly_totals(claims, DRIVER).schema)
    streamed = per_day.groupBy("month").agg(F.sum("claims").alias("claims"), F.sum("paid").alias("paid"))
    batch = monthly_totals(claims, DRIVER).groupBy("month").agg(F.sum("claims").alias("claims"),
                                                               F.sum("paid").alias("paid"))
    assert sorted(streamed.collect()) == sorted(batch.collect())
