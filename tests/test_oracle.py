"""Every registered query of the core against its SQL in another engine, on the smallest tables."""

import math

import pytest

from gyeol import catalogue


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, small, duck, name):
    df = catalogue.QUERIES[name](spark, small)
    names = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    rel = duck.execute(catalogue.ORACLE[name])
    columns = [x[0] for x in rel.description]
    assert sorted(columns) == names
    want = sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, small, name):
    df = catalogue.QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_filters_reach_the_scan(spark, small):
    from gyeol.queries.search import GROUPS, _scope
    from gyeol.functions.text import contains_all
    from pyspark.sql import functions as F

    df = _scope(spark, small).where(contains_all(F.col("compact"), GROUPS)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(compact" in plan
    assert "raw" not in plan.split("FileScan")[1].split("ReadSchema")[1][:200]
