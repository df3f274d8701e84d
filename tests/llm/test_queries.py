"""Registered queries against their SQL, and the driver contract."""

import pytest

import __spark_entry__ as E

from .conftest import SF

SQL = ["op2_substring_dedup", "op4_url_filters", "op5_line_rules", "op8_mixing", "op10_jaccard_join", "op11_lexical_search", "op12_warc", "op13_merkle_manifest"]


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def test_names():
    names = [k for k in E.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", SQL)
def test_query_matches_sql(spark, duck, name):
    df = E.queries()[name](spark, SF)
    cur = duck.execute(E.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cur.fetchall())


def test_oracle_is_sql_text():
    assert {k: v for k, v in E.oracle_sql().items() if not isinstance(v, str)} == {}
