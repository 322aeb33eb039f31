"""Every registered query with SQL, compared with DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from quern import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    got = plans.QUERIES[name](spark, sf_dir)
    want = duck.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    mine = sorted(str([plain(r[c]) for c in order]) for r in got.collect())
    theirs = sorted(str([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLE_SQL.keys()


def test_entry_point_works_without_the_training_data_operators(spark):
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_joins_divisions_and_casts_run_over_whole_tables(spark, sf_dir):
    count = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    run = lambda name: plans.QUERIES[name](spark, sf_dir)
    full = run("join_full")
    assert full.where("s_suppkey IS NOT NULL").count() == count("supplier") and full.where("c_custkey IS NOT NULL").count() == count("customer")
    assert run("fn_int_division").count() == count("orders") and run("pred_cast").count() == count("events")
