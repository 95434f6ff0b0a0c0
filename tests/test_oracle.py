"""Every query with SQL against DuckDB on the smallest tables."""

import decimal
import glob
import inspect
import math
import os

import duckdb
import pytest

from spanforge.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal) and v == int(v):
        return str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(plain(r[c]) for c in cols) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("form", ["train_exact", "train_mixed"])
def test_perceptron_queries_train_on_all_train_cases(spark, monkeypatch, form):
    from spanforge.plans import model_queries as mq

    kind, seen = inspect.signature(getattr(mq.perceptron, form)), []
    monkeypatch.setattr(mq.perceptron, form, lambda *a, **k: seen.append(kind.bind(*a, **k)))
    registry.QUERIES[f"perceptron_{form}"](spark, SF)
    seen[0].apply_defaults()
    assert seen[0].arguments["epochs"] == kind.parameters["epochs"].default
    want = mq.split_rows(spark, SF).where("split = 'train'").select("sid")
    assert sorted(r.sid for r in seen[0].arguments["cases"].select("sid").collect()) == sorted(r.sid for r in want.collect())
