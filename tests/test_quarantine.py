"""Rows that break rules, told apart in one pass."""

from pyspark.sql import functions as F

from claimwise.operators import checks
from claimwise.operators.checks import Unique

def rules():
    return {"negative": F.col("x") < 0, "no_name": F.col("name").isNull(), "id_unique": Unique("id"), "large": F.col("x") > 100}


def frame(spark):
    rows = [(1, "a", 5), (2, "b", -5), (3, None, -7), (4, "d", 200), (4, "e", 1), (None, "f", 1), (5, "g", None), (6, None, 1)]
    return spark.createDataFrame(rows, "id long, name string, x int")


def test_all_reasons_are_told(spark):
    q = checks.quarantine(frame(spark), rules())
    assert sorted(r.id for r in q.good.collect()) == [1, 5] and q.good.columns == ["id", "name", "x"]
    got = {(r.id, r.name): r.reject_reasons for r in q.rejected.collect()}
    assert got == {
        (2, "b"): ["negative"], (3, None): ["negative", "no_name"], (4, "d"): ["id_unique", "large"], (4, "e"): ["id_unique"],
        (None, "f"): ["id_unique"], (6, None): ["no_name"],
    }
    assert {r.check_name: (r.violations, r.passed) for r in q.counts.collect()} == {
        "negative": (2, False), "no_name": (2, False), "id_unique": (3, False), "large": (1, False)}
    assert (q.rows, q.rejected_rows) == (8, 6)


def test_nothing_wrong_everything_wrong_and_empty(spark):
    fine = checks.quarantine(frame(spark).where("id = 1"), rules())
    assert fine.rejected.count() == 0 and fine.good.count() == 1 and all(r.passed for r in fine.counts.collect())
    bad = checks.quarantine(frame(spark), {"all": F.lit(True)})
    assert bad.good.count() == 0 and bad.rejected_rows == 8
    none = checks.quarantine(frame(spark).limit(0), rules())
    assert none.good.count() == none.rejected.count() == none.rows == 0


def test_rules_count_as_the_checks_do(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    by_rule = {r.check_name: r.violations for r in E.queries()["quarantine_counts"](spark, SF_SMALL).collect()}
    by_check = {r.check_name: r.violations for r in E.queries()["faulty_chk_claims"](spark, SF_SMALL).collect()}
    both = set(by_check) - {"chk_claim_id_unique"}  # there only the rows beyond the first count
    assert {k: by_rule[k] for k in both} == {k: by_check[k] for k in both} and all(by_check.values())
    assert by_rule["chk_claim_id_unique"] > by_check["chk_claim_id_unique"] > 0
    rows = E.queries()["quarantine_claims"](spark, SF_SMALL)
    assert rows.where("reject_reasons LIKE '%,%'").count() > 0


def test_keys_that_share_a_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(checks, "_hash", lambda key: F.when(F.col(key).isNotNull(), F.pmod(F.col(key), F.lit(2)).cast("long")))
    test_all_reasons_are_told(spark)
    for stored in (False, True):
        res = checks.run_checks(frame(spark), {"id": Unique("id"), "rows": F.count(F.lit(1))}, stored=stored).collect()
        assert [(r.check_name, r.violations) for r in res] == [("id", 2), ("rows", 8)]
    none = checks.run_checks(frame(spark).limit(0), {"id": Unique("id")}, stored=True).first()
    assert (none.violations, none.passed) == (0, True)


def test_rows_are_not_dealt_out_by_a_long_key(spark):
    """Repeated keys beyond the broadcast bound, whose hashes are within it."""
    rows = spark.range(6000).select(F.sha2(F.pmod("id", F.lit(3000)).cast("string"), 512).alias("id"), F.lit(1).alias("x"))
    conf = {"claimwise.broadcastMaxBytes": "100000", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = checks.tagged(rows, {"id_unique": Unique("id")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.where("size(reject_reasons) = 1").count() == 6000
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def small_bound(monkeypatch, most):
    from claimwise.sources import joins

    monkeypatch.setattr(joins, "DEFAULT_MAX_BYTES", most)


def test_rows_are_not_dealt_out_for_many_repeated_keys(spark, monkeypatch):
    """Hashes of repeated keys beyond the broadcast bound: a bit a row comes back."""
    rows = spark.range(70000).select(
        F.when(F.col("id") < 60000, F.sha2(F.pmod("id", F.lit(30000)).cast("string"), 256)).when(F.col("id") < 69990, F.col("id").cast("string")).alias("id"),
        F.col("id").alias("_row"))
    small_bound(monkeypatch, 100000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = checks.tagged(rows, {"id_unique": Unique("id")})
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {bool(r.reject_reasons): r["count"] for r in out.groupBy("reject_reasons").count().collect()}
        again = out.where("size(reject_reasons) = 1").agg(F.count_if(F.col("_row") < 60000), F.count_if(F.col("id").isNull()), F.count("*")).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == ["id", "_row", "reject_reasons"] and got == {True: 60010, False: 9990} and tuple(again) == (60000, 10, 60010)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_repeated_keys_that_share_hashes(spark, monkeypatch):
    small_bound(monkeypatch, 1)
    test_all_reasons_are_told(spark)
    test_nothing_wrong_everything_wrong_and_empty(spark)
    test_keys_that_share_a_hash_are_told_apart(spark, monkeypatch)
