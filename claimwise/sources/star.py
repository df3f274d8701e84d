"""The star as tables: staged, checked, then swapped in.

``load_star`` writes every table under a staging name (the fact by service year and
in buckets of its join key), reads the staged tables back to enforce the declared
constraints (primary keys, NOT NULL, value lists, non-negative amounts, foreign
keys), and only then lets them take the place of the star that was there. A load
that fails, at whatever point, leaves the old star as it was and nothing staged.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwise.operators import checks
from claimwise.session import PACKED, ensure_checkpoint_dir


class ConstraintViolated(ValueError):
    """``violations``: constraint -> rows."""

    def __init__(self, violations: dict[str, int]):
        super().__init__("the star breaks its constraints: " + ", ".join(f"{k} ({n} rows)" for k, n in violations.items()))
        self.violations = violations


@dataclass(frozen=True)
class Layout:
    """How a table is stored: partition columns, and buckets of a key."""

    partition_by: tuple[str, ...] = ()
    bucket_by: str | None = None
    buckets: int = 32


#: The fact joins providers most, and reports slice it by year.
STAR_LAYOUT = {"claims": Layout(("service_year",), "provider_id"), "providers": Layout(bucket_by="provider_id")}
FOREIGN_KEYS = {"claims": {"patient_id": "patients", "provider_id": "providers"}}


def violations(tables: Mapping[str, DataFrame], in_list: dict | None = None, foreign_keys: dict | None = None) -> DataFrame:
    """(check_name, violations, passed) of the declared constraints of all tables, which
    are stored ones."""
    foreign_keys = FOREIGN_KEYS if foreign_keys is None else foreign_keys
    out = None
    for name, df in tables.items():
        own = checks.constraint_checks(name, df.columns, in_list=(in_list or {}).get(name))
        part = checks.run_checks(df, own, stored=True).withColumn("check_name", F.concat(F.lit(f"{name}."), "check_name")) if own else None
        for fk, dim in foreign_keys.get(name, {}).items():
            if dim in tables and fk in df.columns:
                lost = checks.foreign_key_violations(df, tables[dim], fk, fk, "violations")
                row = lost.select(F.lit(f"{name}.con_foreign_key.{fk}").alias("check_name"), F.col("violations").cast("bigint").alias("violations"), (F.col("violations") == 0).alias("passed"))
                part = row if part is None else part.unionByName(row)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def _write(df: DataFrame, table: str, path: str, layout: Layout) -> None:
    """Rows are dealt out by bucket and partition first, so that each pair is few files;
    Spark splits a pair that is too large (a hot key's bucket) into several."""
    if layout.bucket_by:
        own = "_bucket"
        df = df.withColumn(own, F.pmod(F.hash(layout.bucket_by), F.lit(layout.buckets)))
        df = df.hint("rebalance", own, *layout.partition_by).drop(own)
    writer = df.write.mode("error").option("path", path).option("compression", PACKED)
    if layout.bucket_by:
        writer = writer.bucketBy(layout.buckets, layout.bucket_by).sortBy(layout.bucket_by)
    if layout.partition_by:
        writer = writer.partitionBy(*layout.partition_by)
    writer.saveAsTable(table)


def _drop(spark: SparkSession, table: str) -> None:
    """The table and its files."""
    if not spark.catalog.tableExists(table):
        return
    where = [r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {table}").collect() if r["col_name"] == "Location"]
    spark.sql(f"DROP TABLE {table}")
    for path in where:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    """A folder on whatever file system Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_star(spark: SparkSession, tables: Mapping[str, DataFrame], database: str = "default", prefix: str = "", path: str | None = None,
              layout: Mapping[str, Layout] | None = None, in_list: dict | None = None, enforce: bool = True) -> dict[str, str]:
    """Replace the star's tables (``database.prefix + name``, files below ``path``) and
    return their full names. With ``enforce``, a star that breaks a declared constraint
    raises ``ConstraintViolated`` and is not loaded."""
    layout = STAR_LAYOUT if layout is None else layout
    base = f"{(path or ensure_checkpoint_dir(spark)).rstrip('/')}/claimwise-star-{uuid.uuid4().hex}"
    tag = uuid.uuid4().hex[:12]
    final = {n: f"{database}.{prefix}{n}" for n in tables}
    staged = {n: f"{database}.{prefix}{n}__staged_{tag}" for n in tables}
    kept = {n: f"{database}.{prefix}{n}__old_{tag}" for n in tables}
    moved: list[str] = []
    try:
        for n, df in tables.items():
            _write(df, staged[n], f"{base}/{n}", layout.get(n, Layout()))
        if enforce:
            found = violations({n: spark.table(t) for n, t in staged.items()}, in_list)
            broken = {r["check_name"]: r["violations"] for r in found.where("NOT passed").collect()} if found is not None else {}
            if broken:
                raise ConstraintViolated(broken)
        for n in tables:
            if spark.catalog.tableExists(final[n]):
                spark.sql(f"ALTER TABLE {final[n]} RENAME TO {kept[n]}")
            moved.append(n)
            spark.sql(f"ALTER TABLE {staged[n]} RENAME TO {final[n]}")
    except BaseException:
        for n in moved:  # the old tables take their place again
            if spark.catalog.tableExists(kept[n]):
                _drop(spark, final[n])
                spark.sql(f"ALTER TABLE {kept[n]} RENAME TO {final[n]}")
            else:
                _drop(spark, final[n])
        for t in staged.values():
            _drop(spark, t)
        _delete(spark, base)
        raise
    for t in kept.values():
        _drop(spark, t)
    return final


def drop_star(spark: SparkSession, names: Mapping[str, str], files: bool = True) -> None:
    """Remove a loaded star from the catalog, with its files unless they are still read."""
    for t in names.values():
        _drop(spark, t) if files else spark.sql(f"DROP TABLE IF EXISTS {t}")


def row_counts(spark: SparkSession, names: Mapping[str, str]) -> DataFrame:
    """(table_name, row_count) read back from the tables."""
    out = None
    for n, t in names.items():
        c = spark.table(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        out = c if out is None else out.unionByName(c)
    return out
