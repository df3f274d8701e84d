"""Named queries kept with a manifest; figures of several routes compared."""

import pytest
from pyspark.sql import functions as F

from claimwise.operators import reconcile
from claimwise.operators.reconcile import Figure
from claimwise.plans import results
from conftest import SF_SMALL


def test_every_result_is_kept_and_a_failure_is_told(spark, tmp_path):
    import __spark_entry__ as E

    names = ["q01_headline_kpis", "q06_provider_outliers", "e09_processing_histogram", "dq1_row_counts", "r02_reason_dollars"]
    queries = {n: E.queries()[n] for n in names}
    queries["broken"] = lambda s, d: s.read.parquet(f"{d}/none.parquet")
    queries["late"] = lambda s, d: s.range(3).select(F.raise_error(F.lit("too late")))
    queries["empty"] = lambda s, d: s.range(0)
    out = str(tmp_path / "results")
    rows = {r.query: r for r in results.run_all(spark, queries, SF_SMALL, out, titles={"empty": "Nothing"}).collect()}
    assert list(rows) and set(rows) == set(queries)
    assert rows["broken"].error and "too late" in rows["late"].error and rows["broken"].row_count is None
    assert (rows["empty"].row_count, rows["empty"].title, rows["empty"].error) == (0, "Nothing", None)
    assert rows["q06_provider_outliers"].title == "Q06: provider outliers"
    for n in names:
        direct = queries[n](spark, SF_SMALL)
        assert tuple(direct.agg(*results.content(direct)).first()) == (rows[n].row_count, rows[n].content_hash)
        assert spark.read.parquet(rows[n].path).count() == rows[n].row_count
    assert spark.read.parquet(f"{out}/_manifest").count() == len(queries)


def test_content_ignores_order_but_not_repeats(spark):
    a = spark.createDataFrame([(1, "x", [1]), (2, None, None)], "a int, b string, c array<int>")
    value = lambda df: tuple(df.agg(*results.content(df)).first())
    assert value(a) == value(a.orderBy(F.desc("a")).select("c", "b", "a"))
    assert value(a) != value(a.union(a.limit(1))) and value(a) != value(a.withColumn("a", F.lit(1)))


def test_reconcile_finds_a_planted_difference(spark):
    one = lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))
    routes = {"sql": one(paid=1000.0, rate=12.2, none=1.0), "sheet": one(paid=1000.49, rate=0.1224, none=2.0), "cards": one(paid=1001.6, rate=0.1231, none=3.0)}
    figures = {
        "paid": [Figure("sql", "paid"), Figure("sheet", "paid", 2), Figure("cards", "paid", 2)],
        "rate": [Figure("sql", "rate", 1), Figure("sheet", "rate", 2, 100.0), Figure("cards", "rate", 2, 100.0)],
    }
    got = {(r.figure, r.route): (r.equal, r.difference) for r in reconcile.reconcile(routes, figures).collect()}
    assert got == {("paid", "sheet"): (True, 0.49), ("paid", "cards"): (False, 1.6), ("rate", "sheet"): (True, 0.04), ("rate", "cards"): (False, 0.11)}


def test_reconcile_missing_values(spark):
    routes = {n: spark.createDataFrame([(v,)], "x double") for n, v in (("a", None), ("b", None), ("c", 1.0))}
    got = reconcile.reconcile(routes, {"x": [Figure("a", "x"), Figure("b", "x"), Figure("c", "x")]}).collect()
    assert [(r.route, r.equal) for r in got] == [("b", True), ("c", False)]


@pytest.mark.parametrize("route", ["sheet", "cards"])
def test_headline_figures_agree_until_one_is_changed(spark, route):
    from claimwise.plans.registry import routes as all_routes

    routes = all_routes(spark, SF_SMALL)
    figures = {k: [f for f in v if f.route in ("sql", "sheet", "cards")] for k, v in reconcile.HEADLINE.items() if v[0].route in ("sql", "sheet")}
    assert all(r.equal for r in reconcile.reconcile(routes, figures).collect())
    routes[route] = routes[route].withColumn("denied_billed", F.col("denied_billed") * 1.01)
    assert [(r.figure, r.route) for r in reconcile.reconcile(routes, figures).where("NOT equal").collect()] == [("denied_billed", route)]


@pytest.fixture
def facts_made(monkeypatch):
    """How often the claims are made from their tables."""
    from claimwise.sources import tpch

    calls, make = [], tpch._raw_fact
    monkeypatch.setattr(tpch, "_raw_fact", lambda *a, **k: calls.append(a) or make(*a, **k))
    return calls


def test_routes_share_the_claims(spark, facts_made):
    from claimwise.plans.registry import routes as all_routes

    assert all(r.equal for r in reconcile.reconcile(all_routes(spark, SF_SMALL), reconcile.HEADLINE).collect())
    assert len(facts_made) == 1


def test_a_run_of_queries_makes_common_tables_once(spark, tmp_path, facts_made):
    import __spark_entry__ as E
    from claimwise.session import Prepared

    names = ["q01_headline_kpis", "q06_provider_outliers", "dq6_imputed_share", "clean_claims", "chk_claims", "quarantine_good", "quarantine_counts",
             "csv_clean_claims", "csv_claim_rejects", "faulty_con_claims", "feat_wide_claims", "sink_extract"]
    queries = {n: E.queries()[n] for n in names}
    shared = {r.query: r for r in results.run_all(spark, queries, Prepared(SF_SMALL), str(tmp_path / "a")).collect()}
    assert len(facts_made) == 3 and not [r.error for r in shared.values() if r.error]  # claims without and with codes, raw claims
    alone = {r.query: r for r in results.run_all(spark, queries, SF_SMALL, str(tmp_path / "b")).collect()}
    assert {n: (r.row_count, r.content_hash) for n, r in shared.items()} == {n: (r.row_count, r.content_hash) for n, r in alone.items()}


def test_a_table_that_failed_is_made_again(spark):
    from claimwise.session import Prepared, prepared

    d = Prepared(SF_SMALL)
    with pytest.raises(ZeroDivisionError):
        prepared(d, "x", lambda: spark.range(1 // 0))
    first = prepared(d, "x", lambda: spark.range(3))
    assert prepared(d, "x", lambda: spark.range(9)) is first and first.count() == 3 and d == SF_SMALL
    assert prepared(SF_SMALL, "x", lambda: 7) == 7


def test_many_queries_parse_and_join_once(spark, tmp_path, monkeypatch):
    import __spark_entry__ as E
    from claimwise.operators import clean
    from claimwise.session import PreparedForMany
    from claimwise.sources import tpch

    parses, joins, parse, join = [], [], clean._parsed, tpch._joined
    monkeypatch.setattr(clean, "_parsed", lambda *a: parses.append(a) or parse(*a))
    monkeypatch.setattr(tpch, "_joined", lambda *a: joins.append(a) or join(*a))
    names = ["q01_headline_kpis", "q06_provider_outliers", "r08_provider_table", "feat_wide_claims", "clean_claims", "claim_rejects", "csv_clean_claims", "csv_claim_rejects"]
    queries = {n: E.queries()[n] for n in names}
    told = lambda d, out: {r.query: (r.row_count, r.content_hash, r.error) for r in results.run_all(spark, queries, d, str(tmp_path / out)).collect()}
    shared = told(PreparedForMany(SF_SMALL), "a")
    assert (len(parses), len(joins)) == (2, 1)  # raw claims and those of the CSV
    assert shared == told(SF_SMALL, "b")


def test_wide_claims_are_not_shared_where_a_dimension_repeats_a_key(spark, tmp_path):
    import __spark_entry__ as E
    from claimwise.session import PreparedForMany
    from claimwise.sources import tpch

    for n in ("lineitem", "orders", "customer", "supplier", "part", "nation", "region"):
        rows = tpch.table(spark, SF_SMALL, n)
        (rows.union(rows.where("s_suppkey = 3")) if n == "supplier" else rows).write.parquet(str(tmp_path / f"{n}.parquet"))
    d = PreparedForMany(str(tmp_path))
    for n in ("q01_headline_kpis", "e03_trend_by_type"):
        one, many = (E.queries()[n](spark, where) for where in (str(tmp_path), d))
        assert tuple(one.agg(*results.content(one)).first()) == tuple(many.agg(*results.content(many)).first())
    assert tpch.wide(spark, d).count() > tpch.wide(spark, d, with_patients=False, with_providers=False).count()
