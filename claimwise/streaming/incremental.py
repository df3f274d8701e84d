"""The monthly figures as a Structured Streaming query.

The reference is batch only; this module shows that the same operator
(``trends``-style monthly aggregate) runs unchanged on a streaming
DataFrame: claim files landing in a folder are read with ``readStream``,
aggregated per service day, and the running totals are written to any sink
(memory in tests, a table or files in production via ``foreachBatch``). There
is no watermark: claims are submitted 90 days and more after the service, and
each one counts however late it comes. The state is one row per service day,
so it is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.config import DEFAULT, ClaimsConfig
from claimwise.functions import count_if
from claimwise.operators.kpis import decided, denied


def read_claims_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                       max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def monthly_totals(claims: DataFrame, cfg: ClaimsConfig = DEFAULT) -> DataFrame:
    """Claims, decided, denied, billed and paid per service day (with its
    month); works on a batch or a streaming DataFrame. A sink upserts rows by
    ``service_day`` and months are a rollup of it."""
    d = claims.withColumn("service_day", F.col(cfg.service_date).cast("timestamp"))
    return d.groupBy("service_day", F.date_format("service_day", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("claims"),
        count_if(decided(cfg)).alias("decided"),
        count_if(denied(cfg)).alias("denied"),
        F.sum(cfg.billed).alias("billed"),
        F.sum(cfg.paid).alias("paid"),
    )


def start_monthly(stream: DataFrame, sink, checkpoint: str, cfg: ClaimsConfig = DEFAULT, trigger_once: bool = True):
    """Start the monthly aggregate; ``sink(batch_df, epoch_id)`` receives
    each micro-batch's updated rows (``foreachBatch``: idempotent upserts)."""
    q = monthly_totals(stream, cfg).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    q = q.foreachBatch(sink)
    if trigger_once:
        q = q.trigger(availableNow=True)
    return q.start()
