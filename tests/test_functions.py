import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyweft.functions import healpix, sky, wcs


def _sphere(n, seed=0):
    p = np.random.default_rng(seed).normal(size=(n, 3))
    return p / np.linalg.norm(p, axis=1, keepdims=True)


def _rows(spark, p):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "id long, x double, y double, z double")


@pytest.mark.parametrize("nside", [1, 2, 5, 16])
def test_cell_expression_equals_numpy(spark, nside):
    p = np.vstack([_sphere(800), [[0, 0, 1], [0, 0, -1], [1, 0, 0], [-1, 0, 0], [0, -1, 0]]])
    got = {r["id"]: r["cell"] for r in healpix.with_cell(_rows(spark, p), nside).collect()}
    assert [got[i] for i in range(len(p))] == healpix.cells_of(p, nside).tolist()


#: Stars 2e-6 of a cell from a border: thirds rounded to six digits put them on the other side of it.
BORDER = [(float.fromhex("-0x1.5657a825d302fp-1"), float.fromhex("-0x1.535c994572006p-1"), float.fromhex("0x1.5922342a00000p-2")), (float.fromhex("0x1.0ee66d52f2f80p-7"), float.fromhex("0x1.e406cb460bfaep-1"), float.fromhex("-0x1.4dbb97ac00000p-2"))]


@pytest.mark.parametrize("nside,want", [(4, [33, 81]), (8, [138, 330])])
def test_cells_of_stars_beside_a_border(spark, nside, want):
    assert healpix.cells_of(np.array(BORDER), nside).tolist() == want
    assert [r.cell for r in healpix.with_cell(_rows(spark, BORDER), nside).orderBy("id").collect()] == want


def test_cells_of_poles_keep_the_sign_of_zero(spark):
    """A star at a pole lies in the cell of its longitude, which its zeros' signs tell."""
    poles = [(x, y, z) for z in (1.0, -1.0) for x in (0.0, -0.0) for y in (0.0, -0.0)]
    for nside in (1, 4, 8):
        want = healpix.cells_of(np.array(poles), nside).tolist()
        assert len(set(want)) == 4
        assert [r.cell for r in healpix.with_cell(_rows(spark, poles), nside).orderBy("id").collect()] == want


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_centres_lie_in_their_cells_and_cells_have_equal_area(nside):
    cells = np.arange(12 * nside * nside)
    assert (healpix.cells_of(healpix.points_of(cells, nside), nside) == cells).all()
    count = np.bincount(healpix.cells_of(_sphere(60_000, 3), nside), minlength=len(cells))
    mean = 60_000 / len(cells)
    assert (abs(count - mean) < 6 * math.sqrt(mean)).all()


@pytest.mark.parametrize("nside", [2, 4, 8])
def test_neighbours(nside):
    a, b = healpix.neighbour_pairs(nside)
    degree = np.bincount(a, minlength=12 * nside * nside)
    assert degree.max() == 8 and degree.min() >= 7
    assert (degree == 7).sum() == (24 if nside > 1 else 0)
    p, q = healpix.points_of(a, nside), healpix.points_of(b, nside)
    assert np.degrees(np.arccos((p * q).sum(1))).max() < 2.1 * healpix.cell_radius(nside)


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_ring_and_nested_numbers_are_permutations(spark, nside):
    cells = spark.range(12 * nside * nside).select(F.col("id").alias("cell"))
    rows = cells.select("cell", F.expr(healpix.to_nested("cell", nside)).alias("nested"), F.expr(healpix.to_ring("cell", nside)).alias("ring")).orderBy("cell").collect()
    n = 12 * nside * nside
    assert sorted(r["nested"] for r in rows) == list(range(n))
    assert sorted(r["ring"] for r in rows) == list(range(n))
    z = healpix.points_of(np.array([r["cell"] for r in rows]), nside)[:, 2]
    by_ring = z[np.argsort([r["ring"] for r in rows])]
    assert (np.diff(by_ring) < 1e-9).all()  # rings run from north to south


def test_side_lengths():
    assert abs(healpix.side_arcmin(1) - 3517.9) < 0.1
    assert abs(healpix.side_arcmin(2) - 1758.969) < 0.001
    assert healpix.nside_of(1758.969) == 2


def test_cone_cells_hold_all_points():
    p, c = _sphere(5000, 1), _sphere(5, 2)
    for x, y, z in c:
        inside = p @ np.array([x, y, z]) >= math.cos(math.radians(9))
        assert set(healpix.cells_of(p[inside], 8).tolist()) <= set(healpix.cells_within(x, y, z, 9, 8))


def test_pixel_round_trip_and_behind(spark):
    w = wcs.Tan((359.9, 60.0), (512.0, 300.0), (-0.01, 0.002, 0.002, 0.01))
    x, y, z = wcs.pixel_to_xyz(w, "px", "py")
    px, py = wcs.sky_to_pixel(w, "x", "y", "z")
    df = spark.createDataFrame([(0.0, 0.0), (100.5, 900.25), (512.0, 300.0)], "px double, py double")
    back = df.select("px", "py", F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(z).alias("z")).select("px", "py", F.expr(px).alias("qx"), F.expr(py).alias("qy")).collect()
    assert all(abs(r.px - r.qx) < 1e-8 and abs(r.py - r.qy) < 1e-8 for r in back)
    p = -w.basis()[0]
    assert _rows(spark, [p]).select(F.expr(px).alias("px")).first()["px"] is None


def test_polynomial_distortion(spark):
    w = wcs.Tan((10.0, 0.0), (0.0, 0.0), (1.0, 0.0, 0.0, 1.0), a={(2, 0): 0.5}, b={(1, 1): 0.25})
    ra, dec = wcs.pixel_to_sky(w, "px", "py")
    plain = wcs.Tan((10.0, 0.0), (0.0, 0.0), (1.0, 0.0, 0.0, 1.0))
    pra, pdec = wcs.pixel_to_sky(plain, "px + 0.5 * px * px", "py + 0.25 * px * py")
    r = spark.createDataFrame([(2.0, 4.0)], "px double, py double").select(*[F.expr(e).alias(n) for n, e in zip("abcd", (ra, dec, pra, pdec), strict=True)]).first()
    assert abs(r.a - r.c) < 1e-9 and abs(r.b - r.d) < 1e-9


def test_fit_recovers_a_projection():
    w = wcs.Tan((40.0, 20.0), (50.0, 60.0), (-0.001, 0.0005, 0.0005, 0.001))
    pix = np.random.default_rng(4).uniform(0, 100, (30, 2))
    d = np.radians((pix - np.array(w.crpix)) @ np.array(w.cd).reshape(2, 2).T)
    p = np.column_stack([np.ones(len(d)), d]) @ w.basis()
    got = wcs.fit_tan(p / np.linalg.norm(p, axis=1, keepdims=True), pix)
    assert abs(got.pixel_scale() / w.pixel_scale() - 1) < 1e-4
    assert np.allclose(got.cd, w.cd, atol=1e-6)


def test_sexagesimal_carry_and_parse(spark):
    df = spark.createDataFrame([(359.9999999999, -0.5, "-00:30:00.0"), (15.0, 89.99999999999, "12 30 36")], "ra double, dec double, s string")
    a, b = df.selectExpr(sky.hms("ra") + " AS h", sky.dms("dec") + " AS d", sky.from_sexagesimal("s") + " AS v").collect()
    assert (a.h, a.d, a.v) == ("24:00:00.000", "-00:30:00.000", -0.5)
    assert (b.h, b.d, round(b.v, 9)) == ("01:00:00.000", "+90:00:00.000", 12.51)
    assert spark.sql(f"SELECT {sky.from_sexagesimal(chr(39) + 'x' + chr(39))} AS v").first().v is None


def test_frames_and_photometry(spark):
    l, b = sky.galactic("ra", "dec")
    r = spark.sql(f"SELECT {l} AS l, {b} AS b, {sky.mag_of_flux(sky.flux_of_mag('cast(17.5 as double)'))} AS m FROM (SELECT cast(266.40499 as double) AS ra, cast(-28.93617 as double) AS dec)").first()
    assert min(r.l, 360 - r.l) < 1e-3 and abs(r.b) < 1e-3 and abs(r.m - 17.5) < 1e-9


def test_polygon(spark):
    pts = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 3D), named_struct('x', 0D, 'y', 3D))"
    r = spark.sql(f"SELECT {sky.polygon_area('p')} AS a, {sky.in_polygon('1D', '1D', 'p')} AS i, {sky.in_polygon('5D', '1D', 'p')} AS o FROM (SELECT {pts} AS p)").first()
    assert (r.a, r.i, r.o) == (12.0, True, False)
