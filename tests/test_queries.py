"""Every query with SQL against DuckDB over the smallest tables."""

import math
import os

import pytest

from lipika import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    return ("nan" if math.isnan(v) else f"{v:.8g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    r = duck.execute(queries.ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    theirs = sorted(tuple(map(shown, x)) for x in r.fetchall())
    assert sorted(tuple(map(shown, x)) for x in df.select(cols).collect()) == theirs


def test_ivf_recall(spark):
    ann = {(r.query_id, r.vec_id) for r in queries.ivf_topk(spark, SF).collect()}
    exact = {(r.query_id, r.ix) for r in queries.vector_topk(spark, SF).collect()}
    assert len(ann & exact) >= 0.9 * len(exact)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables here")
def test_ivf_is_calibrated(spark):
    at = "/root/testdata/sf0.01"
    ann = {(r.query_id, r.vec_id) for r in queries.ivf_topk(spark, at).collect()}
    exact = {(r.query_id, r.ix) for r in queries.vector_topk(spark, at).collect()}
    assert len(ann & exact) >= 0.9 * len(exact)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
