"""Date dimension: one row per day between two dates with the calendar
attributes the report model uses. Its size is fixed by the date span (731
rows for two years), so it may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATE_COLS = ("date", "year", "month_number", "month", "month_sort", "quarter", "quarter_label", "quarter_sort")


def calendar_attrs(d: Column) -> dict[str, Column]:
    """Attributes of a date: year, month number, ``MMM yyyy`` label and its
    sort key yyyymm, ``Qn``, ``yyyy Qn`` and its sort key yyyy*10+q."""
    y, m, q = F.year(d), F.month(d), F.quarter(d)
    return {
        "year": y.cast("int"),
        "month_number": m.cast("int"),
        "month": F.date_format(d, "MMM yyyy"),
        "month_sort": (y * 100 + m).cast("int"),
        "quarter": F.concat(F.lit("Q"), q.cast("string")),
        "quarter_label": F.concat(y.cast("string"), F.lit(" Q"), q.cast("string")),
        "quarter_sort": (y * 10 + q).cast("int"),
    }


def dim_date(spark: SparkSession, start: str, end: str) -> DataFrame:
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")
    )
    return days.withColumns(calendar_attrs(F.col("date")))


def with_calendar(df: DataFrame, date_col: str) -> DataFrame:
    """Fact rows carry the attributes of their date (the many-to-one
    relationship to the date dimension, resolved without a join because
    every attribute is a function of the date)."""
    return df.withColumns(calendar_attrs(F.col(date_col)))


def dim_date_for(df: DataFrame, date_col: str) -> DataFrame:
    """Calendar covering whole years from the first to the last date of
    ``date_col`` (one aggregate row, then a bounded sequence)."""
    b = df.agg(F.min(date_col).alias("_lo"), F.max(date_col).alias("_hi"))
    days = b.select(
        F.explode(
            F.sequence(F.make_date(F.year("_lo"), F.lit(1), F.lit(1)), F.make_date(F.year("_hi"), F.lit(12), F.lit(31)))
        ).alias("date")
    )
    return days.withColumns(calendar_attrs(F.col("date")))
