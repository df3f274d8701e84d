"""The star's tables: checked before they replace the old ones."""

import os

import pytest
from pyspark.sql import functions as F

from claimwise.config import DRIVER as C
from claimwise.plans.registry import star_lists
from claimwise.sources import star, tpch
from conftest import SF_SMALL


def tables(spark):
    m = tpch.model(spark, SF_SMALL, codes=True)
    return {"claims": m.claims.withColumn("service_year", F.year("service_date")), "patients": m.patients, "providers": m.providers}


def content(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


def names(spark):
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith("st_"))


@pytest.fixture
def loaded(spark, tmp_path):
    got = star.load_star(spark, tables(spark), prefix="st_", path=str(tmp_path), in_list=star_lists(C))
    yield got
    star.drop_star(spark, got)
    assert names(spark) == []


def test_content_comes_back_and_reload_replaces(spark, tmp_path, loaded):
    for n, df in tables(spark).items():
        assert content(spark.table(loaded[n])) == content(df)
    fewer = tables(spark)
    fewer["claims"] = fewer["claims"].where("service_year > 1997")
    again = star.load_star(spark, fewer, prefix="st_", path=str(tmp_path), in_list=star_lists(C))
    assert again == loaded and content(spark.table(loaded["claims"])) == content(fewer["claims"])
    assert names(spark) == ["st_claims", "st_patients", "st_providers"]
    left = [f for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet") and "/claims/" in d]
    assert len(left) == sum(1 for p in spark.table(loaded["claims"]).inputFiles())
    assert {r.table_name: r.row_count for r in star.row_counts(spark, loaded).collect()}["claims"] == fewer["claims"].count()


def test_join_on_the_bucketed_key_moves_no_fact(spark, loaded):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table(loaded["claims"]).join(spark.table(loaded["providers"]), "provider_id").groupBy("specialty").agg(F.sum("paid_amount"))
        j.collect()
        plan = j._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    plan = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "Exchange hashpartitioning(provider_id" not in plan
    assert "PartitionFilters: [isnotnull(service_year" in spark.table(loaded["claims"]).where("service_year = 1998")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,break_it,says", [
    ("claims", lambda df: df.withColumn("paid_amount", -F.col("paid_amount") - 1), "claims.con_non_negative.paid_amount"),
    ("claims", lambda df: df.withColumn("claim_type", F.lit(None).cast("string")), "claims.con_not_null.claim_type"),
    ("claims", lambda df: df.union(df.limit(1)), "claims.con_primary_key.claim_id"),
    ("patients", lambda df: df.where("patient_id > 5"), "claims.con_foreign_key.patient_id"),
    ("providers", lambda df: df.withColumn("network_status", F.lit("Maybe")), "providers.con_in_list.network_status"),
])
def test_a_star_that_breaks_its_constraints_leaves_the_old_one(spark, tmp_path, loaded, name, break_it, says):
    before = {n: content(spark.table(t)) for n, t in loaded.items()}
    bad = tables(spark)
    bad[name] = break_it(bad[name])
    with pytest.raises(star.ConstraintViolated) as e:
        star.load_star(spark, bad, prefix="st_", path=str(tmp_path), in_list=star_lists(C))
    assert says in e.value.violations
    assert {n: content(spark.table(t)) for n, t in loaded.items()} == before
    assert names(spark) == ["st_claims", "st_patients", "st_providers"]


def test_a_load_that_breaks_off_leaves_the_old_one(spark, tmp_path, loaded, monkeypatch):
    before = {n: content(spark.table(t)) for n, t in loaded.items()}
    bad = tables(spark)
    bad["providers"] = bad["providers"].withColumn("specialty", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        star.load_star(spark, bad, prefix="st_", path=str(tmp_path), in_list=star_lists(C))
    real, calls = type(spark).sql, []

    def sql(self, text, *a, **k):  # the third rename fails, after the first table has been swapped
        calls.append(text)
        if "RENAME" in text and sum("RENAME" in c for c in calls) == 4:
            raise RuntimeError("catalog gone")
        return real(self, text, *a, **k)

    monkeypatch.setattr(type(spark), "sql", sql)
    with pytest.raises(RuntimeError, match="catalog gone"):
        star.load_star(spark, tables(spark), prefix="st_", path=str(tmp_path), in_list=star_lists(C))
    monkeypatch.undo()
    assert names(spark) == ["st_claims", "st_patients", "st_providers"]
    assert {n: content(spark.table(t)) for n, t in loaded.items()} == before


def test_constraints_shuffle_hashes_not_keys(spark):
    """Unique keys leave no key to compare: the check of a stored table moves 8 bytes a row."""
    stored = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 512).alias("claim_id"))
    found = star.violations({"claims": stored}, foreign_keys={})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r.violations for r in found.collect()] == [0] and "LeftSemi" in plan


def test_stored_files_are_packed(spark, loaded):
    assert all(p.endswith(".zstd.parquet") for p in spark.table(loaded["claims"]).inputFiles())
