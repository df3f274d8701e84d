"""Column helpers on hand-computed micro-fixtures."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from claimwise.functions import (
    age_band, lag_band, normalise_code, parse_mixed_dates, pct, ratio, round_half_up, title_case,
)
from claimwise.operators.clean import GENDER_MAP


def col(spark, values, typ, expr):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_mixed_dates_accepts_two_spellings_and_rejects_others(spark):
    out = col(spark, ["2024-03-05", "03/05/2024", "05-03-2024", None], "string", parse_mixed_dates)
    assert out == [dt.date(2024, 3, 5), dt.date(2024, 3, 5), None, None]


def test_code_map(spark):
    out = col(spark, [" f", "Male", "M ", "x", None], "string", lambda c: normalise_code(c, GENDER_MAP))
    assert out == ["Female", "Male", "Male", None, None]


def test_title_case_strips_tabs_and_spaces(spark):
    # dirty/clean pairs of the reference's provider file
    pairs = {" PEDIATRICS ": "Pediatrics", " EMERGENCY MEDICINE ": "Emergency Medicine",
             " PRIMARY CARE ": "Primary Care", "\tRADIOLOGY\n": "Radiology", "Hospital": "Hospital"}
    out = col(spark, list(pairs), "string", title_case)
    assert out == list(pairs.values())


def test_age_bands(spark):
    out = col(spark, [17, 18, 34, 35, 49, 50, 64, 65, -1], "int", age_band)
    assert out == ["0-17", "18-34", "18-34", "35-49", "35-49", "50-64", "50-64", "65+", "0-17"]


def test_lag_bands(spark):
    out = col(spark, [7, 8, 30, 31, 90, 91], "int", lag_band)
    assert [o[:2] for o in out] == ["1)", "2)", "2)", "3)", "3)", "4)"]


def test_round_half_up_on_decimal_digits(spark):
    out = col(spark, [1.005, 2.5, 0.125, -2.5], "double", lambda c: round_half_up(c, 2))
    assert out == [1.01, 2.5, 0.13, -2.5]
    out0 = col(spark, [2.5, 3.5], "double", lambda c: round_half_up(c, 0))
    assert out0 == [3.0, 4.0]


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(0, 0), (1, 4)], "a int, b int")
    r = df.select(ratio("a", "b").alias("r"), pct("a", "b").alias("p")).collect()
    assert r[0]["r"] is None and r[0]["p"] is None
    assert r[1]["r"] == 0.25 and r[1]["p"] == 25.0


def test_money_stays_exact(spark):
    df = spark.createDataFrame([(Decimal("0.10"),)] * 3, "m decimal(18,2)")
    assert df.agg(F.sum("m")).first()[0] == Decimal("0.30")


def test_dates_of_a_known_shape_need_no_formatter(spark):
    texts = ["2024-02-29", " 2024-02-29 ", "02/29/2024", "2023-02-29", "02/30/2024", "13/01/2024", "0000-01-01", "01/01/0000", "2024-1-1", "2024-01-01T",
             "2024-01-01\u0085", "05-03-2024", "2024-01-01 10:00", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t"), parse_mixed_dates("t").alias("d"))
    assert [str(r.d) for r in df.collect()] == ["2024-02-29"] * 3 + ["None"] * (len(texts) - 3)
    assert "gettimestamp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
