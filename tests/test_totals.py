"""Subtotals and totals of measures, and measures of several grains, from one scan."""

import pytest
from pyspark.sql import functions as F

from claimwise.config import DRIVER as C
from claimwise.operators import measures, reports
from claimwise.operators.measures import MEASURES, evaluate
from claimwise.sources import tpch
from claimwise.sources.calendar import with_calendar
from conftest import SF_SMALL

KEYS = ["specialty", "network_status", "plan_type"]
SETS = [("specialty", "network_status", "plan_type"), ("network_status",), ()]


def model(spark):
    return with_calendar(tpch.wide(spark, SF_SMALL, keep_name=True), "service_date")


def values(df, keys):
    return sorted(repr(tuple(r)) for r in df.select(*keys, *[c for c in df.columns if c not in (*KEYS, "year", "level")]).collect())


@pytest.mark.parametrize("filters", [[("year", [1999, 2000])], [("network_status", ["In-Network"]), ("plan_type", ["BUILDING", "MACHINERY"])]])
def test_each_level_is_what_its_keys_give_alone(spark, filters):
    ms = ["Total Claims", "Unique Patients", "Total Paid", "Denial Rate", "Peer Denial Rate", "Excess Denial (pts)", "Paid YTD", "Denials YoY %",
          "In-Network Denial Rate", "Flagged Providers", "Flagged Denied $", "Denial Rate (trend)"]
    got = evaluate(model(spark), ms, KEYS, filters, C, totals=SETS).cache()
    for keys in SETS:
        level = sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)
        part = got.where(F.col("level") == level)
        assert values(part, [k for k in KEYS if k in keys]) == values(evaluate(model(spark), ms, [k for k in KEYS if k in keys], filters, C), [k for k in KEYS if k in keys])
        assert part.where(" OR ".join(f"{k} IS NOT NULL" for k in KEYS if k not in keys) or "false").count() == 0
    assert got.where("level = 7").select("peer_denial_rate").first()[0] is None


def test_keys_beyond_the_group_are_refused(spark):
    with pytest.raises(ValueError):
        evaluate(model(spark), ["Total Claims"], ["specialty"], [], C, totals=[("plan_type",)])


@pytest.fixture
def plans(monkeypatch):
    """Plans of the tables that evaluate writes on the way."""
    seen, real = [], measures.materialize

    def record(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(measures, "materialize", record)
    return seen


def scans(plan):
    return sum("FileScan" in line and "lineitem" in line for line in plan.splitlines())


@pytest.mark.parametrize("what", ["totals", "grains", "cards"])
def test_one_scan_of_the_fact(spark, plans, what):
    m = model(spark)
    if what == "totals":
        out = evaluate(m, ["Total Claims", "Unique Patients", "Peer Denial Rate", "Denial Rate"], KEYS[:2], [], C, totals=[tuple(KEYS[:2]), ()])
    elif what == "grains":
        out = evaluate(m, ["Unique Patients", "Peer Denial Rate", "Paid YTD"], KEYS[:2], [], C)
    else:
        out = reports.all_cards(m, C)
        assert len(out.columns) == len({c for page in reports.KPI_PAGES.values() for c in page})
    out.collect()
    assert sum(map(scans, plans)) + scans(out._jdf.queryExecution().executedPlan().toString()) == 1


@pytest.mark.parametrize("kind", ["dense", "sparse", "text", "negative"])
def test_patients_of_any_id_roll_up_exactly(spark, kind):
    number = {"dense": F.col("id") % 70_000, "sparse": (F.col("id") % 500) * 10_000_000_019, "text": F.concat(F.lit("P"), F.col("id") % 700),
              "negative": F.col("id") % 1000 - 40_000}[kind]
    m = spark.range(3000).select((F.col("id") % 3).alias("a"), (F.col("id") % 7).cast("string").alias("b"), F.when(F.col("id") % 11 > 0, number).alias("patient_id"))
    bits = measures.patient_bitmaps(m.where("patient_id is not null").distinct(), ["a", "b"], "patient_id")
    for keys in (["a", "b"], ["b"], []):
        got = bits.groupBy(*keys, "_bucket").agg(F.bitmap_count(F.bitmap_or_agg("_bits")).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n"))
        want = m.groupBy(*keys).agg(F.countDistinct("patient_id").alias("n"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_every_measure_has_a_column():
    assert len(MEASURES) == len(set(MEASURES.values()))
