"""Every core query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import queries as core


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = core.QUERIES[name](spark, sf_dir)
    rel = duck.sql(core.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert sorted(repr(tuple(plain(v) for v in r)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_query_runs(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_predict_covers_every_row(spark, sf_dir):
    got = core.predict(spark, sf_dir).collect()
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id").collect()]
    assert sorted(r["vec_id"] for r in got) == sorted(ids)
    assert all(r["held_out"] == (r["vec_id"] % 5 == 0) and r["prediction"] is not None for r in got)
