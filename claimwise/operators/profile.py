"""Profiling of a raw table: shape, nulls, distincts, duplicates, value
counts, negatives and a reproducible sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.functions import count_if, round_half_up


def _text(df: DataFrame, col: str) -> Column:
    """A value as text, so that values of all columns fit in one: equal values have
    equal texts, different values different ones."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.col(col) == 0, F.lit("0.0")).otherwise(F.col(col).cast("string"))  # -0.0 is 0.0
    if isinstance(kind, T.BinaryType):
        return F.hex(col)
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.when(F.col(col).isNotNull(), F.to_json(F.struct(col)))
    return F.col(col).cast("string")


def profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: column, dtype, nulls, null_pct (2 dp), unique
    (distinct non-null values). The table is read once: each task turns its rows into
    (column, value), counts these, and one shuffle brings the counts of all columns
    together, so a frequent value is one row from each task and only columns of mostly
    distinct values send about a row a value. ``approx=True`` counts distincts with
    HyperLogLog sketches (``approx_count_distinct``), which shuffle no values."""
    cols = df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if approx:
        parts = [F.struct(F.lit(i).alias("position"), count_if(F.col(c).isNull()).alias("nulls"), F.count(F.lit(1)).alias("rows"),
                          F.approx_count_distinct(c).cast("bigint").alias("unique")) for i, c in enumerate(cols)]
        figures = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    else:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("position"), _text(df, c).alias("value")) for i, c in enumerate(cols)]))
        counted = df.select(cells.alias("cell")).select("cell.*").groupBy("position", "value").agg(F.count(F.lit(1)).alias("n"))
        figures = counted.groupBy("position").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.sum("n").alias("rows"), F.count("value").alias("unique"))
        # an empty table has no cells; its columns are listed all the same
        every = df.sparkSession.createDataFrame([(i,) for i in range(len(cols))], "position int")
        figures = every.join(F.broadcast(figures), "position", "left").fillna(0, ["nulls", "rows", "unique"])  # a row a column
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("position") + 1)
    kind = F.element_at(F.array(*[F.lit(types[c]) for c in cols]), F.col("position") + 1)
    return figures.select(
        F.col("position").cast("int").alias("position"), name.alias("column"), kind.alias("dtype"), F.col("nulls").cast("bigint").alias("nulls"),
        round_half_up(F.try_divide(F.col("nulls").cast("double") * F.lit(100.0), F.col("rows").cast("double")), 2).alias("null_pct"),
        F.col("unique").cast("bigint").alias("unique"),
    ).orderBy("position")


def shape(df: DataFrame) -> DataFrame:
    """rows and column count."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def count_duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier fully identical row (null equals null)."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def count_duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key value appeared on an earlier row."""
    g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_keys"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per distinct non-null value, most frequent first."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(col))
    )


def count_negative(df: DataFrame, col: str) -> DataFrame:
    return df.agg(count_if(F.col(col) < 0).alias("negative_rows"))


def sample_values(df: DataFrame, col: str, n: int = 8, seed: int = 1, key: str | None = None) -> DataFrame:
    """A reproducible sample of ``n`` values: rows ordered by the md5 of
    ``key`` (default: the column itself) and the seed, cut at ``n`` - a top-n,
    so Spark keeps only n rows per task before the final merge."""
    k = F.col(key) if key else F.col(col)
    order = F.md5(F.concat_ws("-", k.cast("string"), F.lit(str(seed))))
    return df.select(col, order.alias("_h")).orderBy("_h", col).limit(n).drop("_h")
