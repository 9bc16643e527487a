"""Segments, polygons, cells beside a cell and sizes of features, each against brute force."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.functions import geometry, healpix
from skyweft.operators import match_stats, spatial, web

SEGMENT = "id long, x0 double, y0 double, x1 double, y1 double"


def _segments(seed, n, first=0):
    """Segments of lengths from 0.01 to 500, some of them upright, level or points."""
    r = np.random.default_rng(seed)
    a = r.uniform(-50, 50, (n, 2))
    d = r.normal(size=(n, 2)) * (10 ** r.uniform(-2, 2.7, n))[:, None]
    d[::17, 0], d[::19, 1], d[::53] = 0, 0, 0
    return [(first + i, *map(float, (*p, *(p + q)))) for i, (p, q) in enumerate(zip(a, d, strict=True))]


def _cross(p, q):
    side = lambda a, b, c, d, x, y: (c - a) * (y - b) - (d - b) * (x - a)
    return side(*p, *q[:2]) * side(*p, *q[2:]) < 0 and side(*q, *p[:2]) * side(*q, *p[2:]) < 0


@pytest.mark.parametrize("cell", [0.05, 4.0, 2000.0])
def test_crossings_equal_all_pairs(spark, cell):
    a, b = _segments(1, 150), _segments(2, 170, 1000)
    got = spatial.segment_crossings(spark.createDataFrame(a, SEGMENT), spark.createDataFrame(b, SEGMENT), cell).collect()
    want = {(s[0], t[0]) for s in a for t in b if _cross(s[1:], t[1:])}
    assert len(got) == len(want) > 100 and {(r.l_id, r.r_id) for r in got} == want
    ends = {s[0]: s[1:] for s in a + b}
    for r in got:
        for x0, y0, x1, y1 in (ends[r.l_id], ends[r.r_id]):
            assert abs((x1 - x0) * (r.y - y0) - (y1 - y0) * (r.x - x0)) < 1e-6 * (1 + math.hypot(x1 - x0, y1 - y0)) ** 2


def test_ordered_crossings_equal_all_pairs(spark):
    r = np.random.default_rng(8)
    p = [(i, *map(float, v)) for i, v in enumerate(r.uniform(0, 100, (3000, 2)))]
    a, b = (spark.createDataFrame([(i, x, y, x + dx, y + dy) for i, x, y in p], SEGMENT) for dx, dy in ((8, 3), (-2, 9)))
    seen = spatial.segment_crossings(a, b, 4.0, ordered=True)
    got = seen.collect()
    want = {(s[0], t[0]) for s in p for t in p if s[0] < t[0] and abs(s[1] - t[1]) < 11 and _cross((s[1], s[2], s[1] + 8, s[2] + 3), (t[1], t[2], t[1] - 2, t[2] + 9))}
    assert {(r.l_id, r.r_id) for r in got} == want and len(got) == len(want)


def test_crossings_of_segments_without_an_end_or_of_none(spark):
    good = [(1, 0.0, 0.0, 2.0, 2.0)]
    odd = [(2, None, 2.0, 2.0, 0.0), (3, float("nan"), 2.0, 2.0, 0.0), (4, float("inf"), 2.0, 2.0, 0.0), (5, 0.0, 2.0, 2.0, 0.0), (6, 0.0, 0.0, 2.0, -1.0)]
    g, o = spark.createDataFrame(good, SEGMENT), spark.createDataFrame(odd, SEGMENT)
    assert [tuple(r) for r in spatial.segment_crossings(g, o, 1.0).collect()] == [(1, 5, 1.0, 1.0)]
    assert spatial.segment_crossings(g, o.where("false"), 1.0).count() == 0
    assert spatial.segment_crossings(g.where("false"), o.where("false"), 1.0).count() == 0


def test_crossing_plan_is_an_equi_join(spark):
    s = spark.createDataFrame(_segments(3, 20), SEGMENT)
    plan = spatial.segment_crossings(s, s, 4.0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_small_cells_of_segments_are_not_shuffled(spark):
    s = spark.createDataFrame(_segments(3, 20), SEGMENT)
    plan = spatial.segment_crossings(s, s, 4.0)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all("level" in d and "cu" not in d for d in dealt)


def test_overlap_areas_equal_a_count_of_points(spark):
    r = np.random.default_rng(5)
    polygon = lambda k: (lambda t: np.column_stack([np.cos(t), np.sin(t)]) * r.uniform(0.5, 2) + r.uniform(-1, 1, 2))(np.sort(r.uniform(0, 2 * np.pi, k)))
    pairs = [(i, polygon(3 + i % 5).tolist(), polygon(3 + i % 4)[:: 1 if i % 2 else -1].tolist()) for i in range(30)]
    # a subject with a notch, one apart from the window, and missing ones
    pairs.append((30, [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [2.0, 1.0], [0.0, 4.0]], [[-1.0, -1.0], [5.0, -1.0], [5.0, 5.0], [-1.0, 5.0]]))
    pairs.append((31, [[9.0, 9.0], [10.0, 9.0], [9.0, 10.0]], pairs[0][2]))
    pairs.append((32, None, pairs[0][2]))
    df = spark.createDataFrame(pairs, "id long, a array<array<double>>, b array<array<double>>")
    got = {row.id: row.area for row in geometry.overlap_areas(df, "a", "b").collect()}
    xs = np.linspace(-4, 6, 1501)
    gx, gy = (v.ravel() for v in np.meshgrid(xs, xs))

    def holds(poly):
        odd = np.zeros(len(gx), bool)
        for (x0, y0), (x1, y1) in zip(poly, poly[1:] + poly[:1], strict=True):
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((y0 > gy) != (y1 > gy)) & (gx < (x1 - x0) * (gy - y0) / (y1 - y0) + x0)
        return odd

    for i, a, b in pairs:
        if a is None:
            assert got[i] is None
        else:
            assert abs(got[i] - (holds(a) & holds(b)).sum() * (xs[1] - xs[0]) ** 2) < 0.05, i
    assert abs(got[30] - 10.0) < 1e-9 and got[31] == 0.0


@pytest.mark.parametrize("cell", [0, 5, 15, 77, 100, 130, 191])
def test_nearby_images_by_touching_edges(spark, cell):
    places = [(f"{n}-{c}", n, c) for n in (1, 2, 4, 8, 16) for c in range(12 * n * n)]
    got = {r.id for r in web.nearby_images(spark.createDataFrame(places, "id string, nside int, cell long"), cell, 4).collect()}
    t = np.linspace(0, 1, 41)
    edge = [np.vstack([healpix.points_of(np.full(41, c), 4, *d) for d in ((t, 0 * t), (t, 0 * t + 1), (0 * t, t), (0 * t + 1, t))]) for c in range(192)]
    near = {c for c in range(192) if (edge[cell] @ edge[c].T).max() > 1 - 1e-9}
    of = lambda n, c: int(healpix.cells_of(healpix.points_of([c], n), 4)[0])
    parent = next(c for c in range(48) if cell in {int(v) for v in healpix.cells_of(np.vstack([healpix.points_of([c], 2, x, y) for x in (0.25, 0.75) for y in (0.25, 0.75)]), 4)})
    assert got == {f"4-{c}" for c in near} | {f"2-{parent}"} | {f"8-{c}" for c in range(768) if of(8, c) in near}


def test_feature_sizes_by_hand(spark):
    r = np.random.default_rng(7)
    ra, dec = r.uniform(0, 360, 40), r.uniform(-80, 80, 40)
    ra[:2], dec[:2] = (359.9, 0.1), (10.0, 10.0)
    p = np.column_stack([np.cos(np.radians(dec)) * np.cos(np.radians(ra)), np.cos(np.radians(dec)) * np.sin(np.radians(ra)), np.sin(np.radians(dec))])
    stars = spark.createDataFrame([(i, *map(float, v), float(i * 7 % 40)) for i, v in enumerate(p)], "id long, x double, y double, z double, mag double")
    quads = [(0, 0, 1, 2, 3)] + [(q, *map(int, r.choice(40, 4, replace=False))) for q in range(1, 25)]
    got = match_stats.feature_sizes(spark.createDataFrame(quads, "quad_id long, a long, b long, c long, d long"), stars).collect()
    assert len(got) == len(quads)
    for row in got:
        _, a, b, c, d = quads[row.quad_id]
        assert abs(row.arcmin - 60 * math.degrees(math.acos(min(1.0, p[a] @ p[b])))) < 1e-4
        m = (p[a] + p[b]) / np.linalg.norm(p[a] + p[b])
        q = np.array([math.cos(math.radians(row.dec)) * math.cos(math.radians(row.ra)), math.cos(math.radians(row.dec)) * math.sin(math.radians(row.ra)), math.sin(math.radians(row.dec))])
        assert np.abs(m - q).max() < 1e-9
        assert row.faintest == max(i * 7 % 40 for i in (a, b, c, d))


def test_feature_sizes_without_features(spark):
    stars = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 2.0)], "id long, x double, y double, z double, mag double")
    quads = spark.createDataFrame([], "quad_id long, a long, b long, c long, d long")
    assert match_stats.feature_sizes(quads, stars).count() == 0


def test_orbits_replace_columns_of_their_name(spark):
    from skyweft.functions import orbits

    e = spark.createDataFrame([(1, 2.0, 0.0, 0.0, 0.0, 0.0, math.pi / 2, "x", 5.0)], "id long, a double, e double, i double, node double, peri double, mean double, orbit_place string, px double")
    out = orbits.with_positions(e)
    assert out.columns == ["id", "a", "e", "i", "node", "peri", "mean", "orbit_place", "px", "py", "pz"]
    row = out.select(F.round("px", 9).alias("px"), F.round("py", 9).alias("py")).first()
    assert (row.px, row.py) == (0.0, 2.0)
