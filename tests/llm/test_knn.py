"""Top-k search against all scores, on spread and on clustered vectors, and how much is sent."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.llm import queries, voronoi_knn
from skyweft.session import materialize

VEC = "vec_id long, embedding array<double>"


def _plain(rows, k=20, every=20, scale=64):
    dim = max(len(v) for _, v in rows)
    x = np.zeros((len(rows), dim), object)
    for i, (_, v) in enumerate(rows):
        x[i, : len(v)] = [int(np.floor(c * scale)) for c in v]
    out = []
    for i, (q, _) in enumerate(rows):
        if q is not None and q % every == 0:
            best = sorted(((-sum(x[i] * x[j]), j_id is None, j_id or 0, j_id) for j, (j_id, _) in enumerate(rows) if j != i))[:k]
            out += [(q, r + 1, b[3], -b[0]) for r, b in enumerate(best)]
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf.replace('0.001', '0.01')}/embeddings.parquet'").fetchall()
    want = sorted(con.execute(queries.ORACLE_SQL["op11_voronoi_knn"]).fetchall(), key=str)
    assert _got(queries.op11_voronoi_knn(spark, sf.replace("0.001", "0.01"))) == want and len(want) == 500


def _clustered(seed, n, dim, clusters, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dim))
    which = np.minimum(r.integers(0, clusters + clusters // 2, n), clusters - 1)  # a third of all rows in the last
    return [(int(i), [float(c) for c in centres[w] + spread * r.normal(size=dim)]) for i, w in zip(r.permutation(n), which, strict=True)]


@pytest.mark.parametrize("dim, group", [(2, 16), (8, 64), (3, 8192)])
def test_clusters_in_parts_and_slices(spark, dim, group):
    rows = _clustered(dim, 900, dim, 12, 0.02)
    df = spark.createDataFrame(rows, VEC).repartition(5)
    assert _got(voronoi_knn.knn_join(df, F.col("vec_id") % 5 == 0, k=7, group=group)) == _plain(rows, 7, 5)


def test_rows_that_no_query_of_a_class_needs_are_not_sent(spark):
    """Unit vectors round well-parted centres: most cells of data are out of reach of most classes."""
    rows = _clustered(5, 3000, 6, 30, 0.01)
    rows = [(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in rows]
    whole = voronoi_knn.whole_vectors(spark.createDataFrame(rows, VEC), "vec_id", "embedding", 64, F.col("vec_id") % 20 == 0)
    whole = materialize(whole, "test-vectors")
    m2 = whole.agg(F.max("norm2")).first()[0]
    pivots = voronoi_knn.Pivots(voronoi_knn._sampled(whole, 60, 6), m2)
    cells = whole.mapInArrow(voronoi_knn._assign(pivots), "row long, vec_id long, e array<bigint>, norm2 long, cell int, dist double, qcell int, qdist double")
    plan = voronoi_knn._planned(cells, pivots, 5, 16)
    x = np.array([r.e for r in whole.select("e").collect()], float)
    share = plan.needed(x, (x**2).sum(1)).mean()
    assert len(plan.parts) > 5 and share < 0.6


def test_ties_repeats_nulls_and_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    good = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.5]), (5, []), (None, [1.0, 0.0]), (40, [-1.0, -2.0, 0.25]), (-20, [0.0, 0.0])]
    bad = [(60, None), (80, [1.0, None]), (100, [nan, 1.0]), (6, [inf, 0.0]), (7, [1e300, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad], "vec_id long, embedding array<double>, score int, dist double")
    for k in (1, 3, 20):
        assert _got(voronoi_knn.embedding_neighbours(df, k=k)) == _plain(good, k)
    assert voronoi_knn.embedding_neighbours(df.limit(0)).count() == 0
    assert voronoi_knn.embedding_neighbours(spark.createDataFrame([(20, [1.0])], VEC)).count() == 0
    assert voronoi_knn.embedding_neighbours(df.where("vec_id in (3, 4)")).count() == 0


def test_all_rows_alike(spark):
    rows = [(i, [0.5, 0.25]) for i in range(300)]
    assert _got(voronoi_knn.knn_join(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, group=16)) == _plain(rows)


@pytest.mark.parametrize("scale", [1, 1 << 10, 1 << 23, 1 << 29])
def test_exact_at_every_size_of_numbers(spark, scale):
    rows = _clustered(scale % 97, 120, 3, 4, 0.3)
    assert _got(voronoi_knn.knn_join(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, k=4, scale=scale)) == _plain(rows, 4, 20, scale)
