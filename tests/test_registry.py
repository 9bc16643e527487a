"""Every catalogue query against its SQL, and what the plans may hold."""

import duckdb
import pytest

import __spark_entry__ as entry
from skyweft.catalog_queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()



@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, rows)


@pytest.mark.parametrize("name", ["sky_radius_join", "sky_counts", "xy_match", "nd_radius_join", "code_match", "quad_codes", "cell_schemes", "uniformize_top", "in_field", "coadd_images", "shift_votes", "footprint_overlaps", "hist2d_discard"])
def test_plans_are_native_and_without_cross_products(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "Pandas"):
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["slice_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(c_custkey,10)" in plan and "c_mktsegment" not in plan
    plan = QUERIES["hist1d_clamped"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_id", "r_id", "dist_deg"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
