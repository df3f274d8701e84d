"""Cell-by-cell typed reading, the profile's single scan, and cuts without a sort."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.operators import profile, ranking
from claimwise.sources import files

SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False), T.StructField("day", T.DateType()), T.StructField("amount", T.DecimalType(18, 2)),
    T.StructField("flag", T.BooleanType()), T.StructField("name", T.StringType(), False),
])


def test_bad_cells_keep_their_row(spark, tmp_path):
    lines = ["id,day,amount,flag,name", "1,2024-03-05, 7.50 ,true,Ann", "x2,03/05/2024,ten,maybe,Bob", "3,2024-02-30,,NA,", "4.0,,1,false,Eve", "5,2024-01-01,1,true,Fay,more", "6,2024-01-01"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    rows = files.read_typed(spark, str(tmp_path / "a.csv"), SCHEMA)
    got = {r.name or r.day or r.id: r for r in rows.collect()}
    ann, bob, eve, fay = (got[n] for n in ("Ann", "Bob", "Eve", "Fay"))
    assert (ann.id, ann.day, ann.amount, ann.flag, ann.cell_errors) == (1, dt.date(2024, 3, 5), Decimal("7.50"), True, [])
    told = lambda r: [(e.column, e.text, e.problem) for e in r.cell_errors]
    assert told(bob) == [("id", "x2", "not a bigint"), ("day", "03/05/2024", "not a date"), ("amount", "ten", "not a decimal(18,2)"), ("flag", "maybe", "not a boolean")]
    assert told(eve) == [("id", "4.0", "not a bigint")] and eve.amount == 1 and eve.day is None
    assert told(fay) == [(None, "5,2024-01-01,1,true,Fay,more", "too many or too few fields")] and fay.id == 5
    third = next(r for r in rows.collect() if r.id == 3)
    assert told(third) == [("day", "2024-02-30", "not a date"), ("name", None, "missing")]
    short = next(r for r in rows.collect() if r.id == 6)
    assert told(short) == [(None, "6,2024-01-01", "too many or too few fields"), ("name", None, "missing")] and short.day == dt.date(2024, 1, 1)
    good, bad = files.split_errors(rows)
    assert [r.name for r in good.collect()] == ["Ann"] and bad.count() == 10 and bad.columns == [*SCHEMA.names, "column", "text", "problem"]


def test_profile_reads_once_and_counts_every_type(spark):
    rows = [(1, "a", 0.0, [1], Decimal("1.50"), b"x", None), (1, "", -0.0, [1], Decimal("1.5"), b"x", None), (None, None, float("nan"), None, None, b"y", None), (2, "a", float("nan"), [], None, None, None)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d array<int>, e decimal(18,2), f binary, g string")
    out = profile.profile(df)
    got = {r["column"]: (r.position, r.dtype, r.nulls, r.null_pct, r["unique"]) for r in out.collect()}
    assert got == {"a": (0, "int", 1, 25.0, 2), "b": (1, "string", 1, 25.0, 2), "c": (2, "double", 0, 0.0, 2), "d": (3, "array<int>", 1, 25.0, 2),
                   "e": (4, "decimal(18,2)", 2, 50.0, 1), "f": (5, "binary", 1, 25.0, 2), "g": (6, "string", 4, 100.0, 0)}
    assert {r["column"]: r["unique"] for r in profile.profile(df, approx=True).collect()} == {k: v[4] for k, v in got.items()}
    assert [(r.nulls, r["unique"], r.null_pct) for r in profile.profile(df.limit(0)).collect()] == [(0, 0, None)] * 7


def test_profile_has_one_scan(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 AS b", "cast(id AS string) AS c").write.parquet(str(tmp_path / "t"))
    plan = profile.profile(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


VALUES = {
    "spread": lambda r, k: Decimal(r.randrange(10**7)) / 100, "ties": lambda r, k: Decimal(r.choice([0, 0, 0, 5, 7])), "same": lambda r, k: Decimal(3),
    "nulls": lambda r, k: r.choice([None, None, Decimal(1), Decimal(r.randrange(100))]), "all null": lambda r, k: None,
    "far": lambda r, k: Decimal(10) ** 13 if k == 3 else Decimal(r.randrange(900)) / 100,
}


@pytest.mark.parametrize("kind", VALUES)
@pytest.mark.parametrize("n,near", [(777, 100_000), (300, 0), (7, 100_000)])
def test_spans_of_tiles_are_those_of_ntile(spark, monkeypatch, kind, n, near):
    """Ties at every cut, also where many rows lie near a cut."""
    monkeypatch.setattr(ranking, "NEAR_ROWS", near)
    r = random.Random(5)
    df = spark.createDataFrame([(k, VALUES[kind](r, k)) for k in range(n)], "id long, v decimal(28,2)")
    got = {x.id: x.g for x in ranking.ntile_groups(df, "v", "id", 100, (1, 5, 20), "g").collect()}
    order = sorted(((-x.v if x.v is not None else Decimal(10) ** 20, x.id) for x in df.collect()))
    ends = [c * (n // 100) + min(c, n % 100) for c in (1, 5, 20)]
    assert got == {k: sum(i >= e for e in ends) for i, (_, k) in enumerate(order)}


def test_spans_of_an_empty_table(spark):
    assert ranking.ntile_groups(spark.createDataFrame([], "id long, v decimal(28,2)"), "v", "id", 100, (1, 5, 20), "g").count() == 0


def test_release_deletes_what_was_written(spark, tmp_path):
    import os

    from claimwise import session

    before = list(session._written)
    session._written.clear()
    try:
        table = session.materialize(spark.range(5))
        folder = session.scratch(spark, "named-only")
        path = session._written[0]
        assert table.count() == 5 and os.path.isdir(path) and not os.path.exists(folder)
        assert session.release() == 1 and not os.path.exists(path) and session.release() == 0
    finally:
        session._written[:] = before


def test_registered_cells_find_each_fault(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    rows = E.queries()["src_csv_cells"](spark, SF_SMALL)
    assert rows.where(F.col("cell_errors") != "").count() >= 7 and rows.where("cell_errors LIKE '%; %'").count() > 0
