"""Operators on hand-computed micro-fixtures (FIXTURES.md section 5)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimwise.config import DEFAULT
from claimwise.operators import checks, clean, members, providers, ranking, reasons, timing, trends
from claimwise.operators.measures import evaluate
from claimwise.sources.calendar import with_calendar

D = dt.date
FACT = ("claim_id string, patient_id string, provider_id string, service_date date, submission_date date, "
        "processed_date date, claim_type string, billed_amount decimal(18,2), allowed_amount decimal(18,2), "
        "paid_amount decimal(18,2), claim_status string, denial_reason string, specialty string, "
        "network_status string, plan_type string, days_to_process int")


def claims(spark, rows):
    """rows: (provider, status, service_date, paid) -> full fact rows."""
    out = []
    for i, (prov, status, sd, paid) in enumerate(rows):
        out.append((f"C{i}", f"P{i % 7}", prov, sd, sd, None if status == "Pending" else sd, "Professional",
                    Decimal("100.00"), Decimal("80.00"), Decimal(str(paid)), status,
                    "Coding error" if status == "Denied" else "Not Applicable", "Cardiology",
                    "In-Network", "Commercial", None if status == "Pending" else 3))
    return spark.createDataFrame(out, FACT)


def provider_dim(spark, ids):
    return spark.createDataFrame([(p, f"Name {p}", "Cardiology", "In-Network") for p in ids],
                                 "provider_id string, provider_name string, specialty string, network_status string")


def test_peer_rate_includes_small_providers_and_filters_after(spark):
    rows = ([("p1", "Denied", D(2024, 1, 1), 0)] * 10 + [("p1", "Paid", D(2024, 1, 1), 5)] * 90
            + [("p2", "Denied", D(2024, 1, 1), 0)] * 60 + [("p2", "Paid", D(2024, 1, 1), 5)] * 140
            + [("p3", "Denied", D(2024, 1, 1), 0)] * 40 + [("p3", "Paid", D(2024, 1, 1), 5)] * 10)
    w = claims(spark, rows)
    out = {r["provider_id"]: r for r in providers.provider_outliers(w, provider_dim(spark, ["p1", "p2", "p3"]), DEFAULT, 100).collect()}
    assert set(out) == {"p1", "p2"}          # p3 below the volume floor ...
    assert out["p1"]["peer_rate_pct"] == 31.4  # ... but counted in the peers: 110/350
    assert out["p2"]["excess_pts"] == round(30.0 - 31.43, 1)


def test_dense_rank_keeps_ties(spark):
    rows = []
    for prov, dollars in (("a", 9), ("b", 9), ("c", 7), ("d", 5), ("e", 3)):
        rows.append((prov, "Denied", D(2024, 1, 1), 0))
    w = claims(spark, rows).withColumn(
        "billed_amount",
        F.when(F.col("provider_id").isin("a", "b"), F.lit(9)).when(F.col("provider_id") == "c", F.lit(7))
        .when(F.col("provider_id") == "d", F.lit(5)).otherwise(F.lit(3)).cast("decimal(18,2)"))
    out = providers.top_per_specialty(w, provider_dim(spark, list("abcde")), DEFAULT, k=3).collect()
    assert [r["rnk"] for r in out] == [1, 1, 2, 3]


def test_ntile_sizes_match_sql(spark):
    df = spark.range(7946).select(F.col("id").cast("string").alias("m"), (F.col("id") % 97).alias("v"))
    b = ranking.ntile(df, [F.col("v").desc(), F.col("m")], 100, "bucket", partitions=7)
    sizes = dict(b.groupBy("bucket").count().collect())
    assert sizes[1] == 80 and sizes[46] == 80 and sizes[47] == 79 and sizes[100] == 79
    grp = lambda lo, hi: sum(sizes[i] for i in range(lo, hi + 1))
    assert (grp(1, 1), grp(2, 5), grp(6, 20), grp(21, 100)) == (80, 320, 1200, 6346)


def test_ntile_matches_window_ntile(spark):
    from pyspark.sql import Window

    df = spark.range(1234).select(F.col("id").alias("k"), ((F.col("id") * 7919) % 101).alias("v"))
    mine = ranking.ntile(df, [F.col("v").desc(), F.col("k")], 10, "b", partitions=5)
    ref = df.withColumn("b", F.ntile(10).over(Window.orderBy(F.col("v").desc(), F.col("k"))))
    assert mine.exceptAll(ref.select(*mine.columns)).count() == 0


def test_group_median_exact_and_interpolated(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("a", 10), ("b", 1), ("b", 2), ("b", 4), ("c", None)],
                               "g string, v int")
    out = dict(ranking.group_median(df, ["g"], "v", "m").collect())
    assert out == {"a": 3.0, "b": 2.0}


def test_group_median_hot_group(spark):
    df = spark.range(10001).select(F.lit("hot").alias("g"), F.col("id").alias("v"))
    out = ranking.group_median(df, ["g"], "v", "m").collect()
    assert out[0]["m"] == 5000.0


def test_year_to_date_resets_by_year(spark):
    rows = [("p", "Paid", D(2023, 12, 5), 10), ("p", "Paid", D(2024, 1, 5), 5), ("p", "Paid", D(2024, 2, 5), 6)]
    out = trends.monthly_trend(claims(spark, rows), DEFAULT).collect()
    assert [r["paid_ytd"] for r in out] == [10.0, 5.0, 11.0]
    no_jan = [("p", "Paid", D(2023, 12, 5), 10), ("p", "Paid", D(2024, 2, 5), 6)]
    assert [r["paid_ytd"] for r in trends.monthly_trend(claims(spark, no_jan), DEFAULT).collect()] == [10.0, 6.0]


def test_month_change(spark):
    rows = [("p", "Paid", D(2024, 1, 5), 1)] * 100 + [("p", "Paid", D(2024, 2, 5), 1)] * 80
    out = trends.monthly_trend(claims(spark, rows), DEFAULT).collect()
    assert [r["claims_mom_pct"] for r in out] == [None, -20.0]


def test_rate_only_pending_is_null(spark):
    w = claims(spark, [("p", "Pending", D(2024, 1, 5), 0)] * 2)
    assert timing.submission_lag(w.where("claim_status <> 'Pending'"), DEFAULT).count() == 0
    x = trends.sheet_monthly(w, DEFAULT).first()
    assert x["denial_rate"] == 0.0                     # spreadsheet variant
    assert trends.monthly_trend(w, DEFAULT).first()["denial_rate_pct"] is None


def test_growth_from_zero(spark):
    rows = [("p", "Denied", D(2025, 3, 1), 0)] * 5
    out = reasons.reason_yoy(claims(spark, rows), DEFAULT).first()
    assert out["denials_2024"] == 0 and out["denials_2025"] == 5 and out["yoy_change_pct"] is None
    assert reasons.sheet_reasons(claims(spark, rows), DEFAULT).first()["yoy_change"] == 0.0


def test_histogram_last_bin_closed(spark):
    rows = []
    for days in (0, 1, 2, 79, 80, 81):
        rows.append(("p", "Paid", D(2024, 1, 1), 1, days))
    df = spark.createDataFrame(
        [(f"C{i}", D(2024, 1, 1), D(2024, 1, 1) + dt.timedelta(days=d), "Paid") for i, (_, _, _, _, d) in enumerate(rows)],
        "claim_id string, submission_date date, processed_date date, claim_status string")
    out = {r["bin_start"]: r for r in timing.processing_histogram(df, DEFAULT).collect()}
    assert out[0]["claims"] == 2 and out[2]["claims"] == 1 and out[78]["claims"] == 2
    assert out[0]["density"] == round(2 / (5 * 2), 6)


def test_imputation_median_with_floor(spark):
    df = spark.createDataFrame(
        [("X", Decimal("100"), Decimal("0")), ("X", Decimal("300"), Decimal("0")), ("X", None, Decimal("250")),
         ("X", None, Decimal("50")), ("Y", None, Decimal("40"))],
        "cpt_code string, billed_amount decimal(18,2), allowed_amount decimal(18,2)")
    out = clean.impute_with_floor(df, "billed_amount", "cpt_code", "allowed_amount").collect()
    got = sorted((r["cpt_code"], r["allowed_amount"], r["billed_amount"]) for r in out)
    assert got[2:4] == [("X", Decimal("50.00"), Decimal("200.00")), ("X", Decimal("250.00"), Decimal("250.00"))]
    assert got[4] == ("Y", Decimal("40.00"), None)   # all missing: stays null


def test_dedup_before_normalising(spark):
    raw = spark.createDataFrame(
        [("C1", "P1", "R1", "2024-03-05", "2024-03-06", None, "T", "D", "X", Decimal("1"), Decimal("1"), Decimal("0"), "Pending", None)] * 2
        + [("C1", "P1", "R1", "03/05/2024", "2024-03-06", None, "T", "D", "X", Decimal("1"), Decimal("1"), Decimal("0"), "Pending", None)],
        "claim_id string, patient_id string, provider_id string, service_date string, submission_date string, "
        "processed_date string, claim_type string, diagnosis_category string, cpt_code string, billed_amount decimal(18,2), "
        "allowed_amount decimal(18,2), paid_amount decimal(18,2), claim_status string, denial_reason string")
    c = clean.clean_claims(raw, DEFAULT)
    assert c.count() == 2
    res = {r["check_name"]: r["violations"] for r in checks.run_checks(c, {"u": checks.claim_checks()["chk_claim_id_unique"]}).collect()}
    assert res["u"] == 1
    assert clean.clean_claims(raw, DEFAULT, after_normalise=True).count() == 1


def test_status_domain_requires_every_value(spark):
    df = spark.createDataFrame([("Paid",), ("Denied",)], "claim_status string")
    r = checks.run_checks(df, {"d": checks.domain_violations("claim_status", ("Paid", "Denied", "Pending"))}).first()
    assert r["violations"] == 1 and r["passed"] is False


def test_assert_checks(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int")
    res = checks.run_checks(df, {"neg": F.sum(F.when(F.col("x") < 0, 1).otherwise(0))})
    with pytest.raises(checks.CheckFailed):
        checks.assert_checks(res)


def test_spend_concentration_groups(spark):
    rows = [(f"p{i % 3}", "Paid", D(2024, 1, 1), i % 50) for i in range(400)]
    member = (F.substring("claim_id", 2, 10).cast("int") % 200).cast("string")
    w = claims(spark, rows).withColumn("patient_id", F.concat(F.lit("M"), member))
    out = members.spend_concentration(w, DEFAULT).collect()
    assert [r["members"] for r in out] == [2, 8, 30, 160]
    assert round(sum(r["share_of_paid_pct"] for r in out)) == 100


def test_measure_year_replacement_under_slicer(spark):
    rows = [("p", "Denied", D(2024, 5, 1), 0)] * 3 + [("p", "Denied", D(2025, 5, 1), 0)] * 2
    m = with_calendar(claims(spark, rows).withColumn("provider_name", F.lit("n")), "service_date")
    r = evaluate(m, ["Denials Base", "Denials Compare", "Denied Claims"], [], [("year", [2025])], DEFAULT).first()
    assert (r["denials_base"], r["denials_compare"], r["denied_claims"]) == (3, 2, 2)


def test_measure_complete_rate_intersects_cutoff(spark):
    cfg = DEFAULT.with_(cutoff_date="2025-12-01")
    rows = ([("p", "Denied", D(2025, 10, 1), 0)] + [("p", "Paid", D(2025, 11, 1), 1)] * 3
            + [("p", "Denied", D(2025, 12, 5), 0)] * 4)
    m = with_calendar(claims(spark, rows).withColumn("provider_name", F.lit("n")), "service_date")
    r = evaluate(m, ["Denial Rate (complete)", "Denial Rate"], ["quarter_label"], [], cfg).first()
    assert r["denial_rate_complete"] == 0.25 and r["denial_rate"] == round(5 / 8, 4)


def test_blank_group_vanishes(spark):
    rows = [("p", "Paid", D(2024, 1, 1), 1), ("p", "Denied", D(2024, 1, 1), 0)]
    m = with_calendar(claims(spark, rows).withColumn("provider_name", F.lit("n")), "service_date")
    out = evaluate(m, ["Denied Billed $"], ["denial_reason"], [], DEFAULT).collect()
    assert [r["denial_reason"] for r in out] == ["Coding error"]


def test_replaced_measure_keeps_rows_outside_the_slicer(spark):
    """A reason denied only in the base year still shows under a slicer on
    the compare year (its base-year count is not blank)."""
    rows = [("p", "Denied", D(2024, 5, 1), 0)] * 3 + [("p", "Paid", D(2025, 5, 1), 1)] * 2
    m = with_calendar(claims(spark, rows).withColumn("provider_name", F.lit("n")), "service_date")
    out = {r["denial_reason"]: r for r in evaluate(
        m, ["Denials Base", "Denied Billed $"], ["denial_reason"], [("year", [2025])], DEFAULT).collect()}
    assert out["Coding error"]["denials_base"] == 3 and out["Coding error"]["denied_billed"] is None


def test_ytd_under_quarter_slicer(spark):
    """Paid YTD replaces the date slicer (Jan 1 .. end of the sliced quarter);
    Total Paid respects it; a network slicer stays in force for both."""
    cfg = DEFAULT
    rows = [("p", "Paid", D(2024, 2, 1), 10), ("p", "Paid", D(2024, 5, 1), 20), ("p", "Paid", D(2024, 8, 1), 40)]
    m = with_calendar(claims(spark, rows).withColumn("provider_name", F.lit("n")), "service_date")
    r = evaluate(m, ["Paid YTD", "Total Paid"], [], [("quarter_label", ["2024 Q2"])], cfg).first()
    assert (r["paid_ytd"], r["total_paid"]) == (30.0, 20.0)
    out = evaluate(m, ["Paid YTD", "Total Paid"], [], [("quarter_label", ["2024 Q2"]), ("network_status", ["Out-of-Network"])], cfg)
    assert out.count() == 0   # every claim is in network: all measures blank


def test_default_clause(spark):
    df = spark.createDataFrame([(1,), (None,)], "billed_imputed int")
    assert [r[0] for r in checks.with_default(df, "billed_imputed", 0).collect()] == [1, 0]


def test_group_median_null_key_and_one_value(spark):
    df = spark.createDataFrame([(None, 5), (None, 7), ("x", 3), ("x", 3), ("x", 3)], "g string, v int")
    assert dict(ranking.group_median(df, ["g"], "v", "m").collect()) == {None: 6.0, "x": 3.0}


def test_types_without_a_column_raise(spark):
    rows = [("p", "Paid", D(2024, 1, 5), 10)]
    c = claims(spark, rows).withColumn("claim_type", F.lit("Dental"))
    assert trends.trend_by_type(c, DEFAULT).columns == ["month", "dental"]
    with pytest.raises(Exception, match="Dental"):
        trends.trend_by_type(c, DEFAULT, ["Outpatient"]).collect()


def test_rank_keeps_the_other_keys(spark):
    """Ranks start anew in each context; ties share a rank."""
    from claimwise.operators.measures import _rank

    rows = [(1, "a", 5.0), (1, "b", 5.0), (1, "c", 1.0), (2, "a", None), (2, "b", -1.0), (2, "c", 9.0), (None, "a", 1.0)]
    df = spark.createDataFrame(rows, "year int, provider_name string, _excess double")
    got = {(r.year, r.provider_name): r._rank for r in _rank(df, DEFAULT, ["year", "provider_name"]).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 1, (1, "c"): 3, (2, "a"): 2, (2, "b"): 3, (2, "c"): 1, (None, "a"): 1}
