"""Survey pixels, orbit elements and hints of jobs."""

import math

import numpy as np
from pyspark.sql import functions as F

from skyweft.functions import orbits, survey
from skyweft.operators import hints


def test_survey_pixels_there_and_back(spark):
    r = np.random.default_rng(1)
    one = {"a": 359.9, "b": 1.1e-4, "c": 2e-7, "d": 0.3, "e": -3e-7, "f": 1.1e-4, "d_row0": 0.1, "d_row1": 1e-5, "d_row2": -3e-8, "d_row3": 7e-12, "d_col0": -0.2, "d_col1": 3e-4, "d_col2": 2e-7, "d_col3": -5e-11, "cs_row": 0.02, "cs_col": -0.01, "cc_row": 0.04, "cc_col": -0.03, "ri_cut": 1.5, "node": 95.0, "incl": 32.5}
    rows = [(float(x), float(y), None if k % 9 == 0 else float(c), *one.values()) for k, (x, y, c) in enumerate(r.uniform((0, 0, 0), (2048, 1489, 3), (400, 3)))]
    df = spark.createDataFrame(rows, "x double, y double, colour double, " + ", ".join(f"{c} double" for c in one))
    assert tuple(one) == survey.CALIBRATION
    back = survey.with_pixels(survey.with_sky(df)).select("x", "y", "px", "py", "ra", "dec").collect()
    assert max(max(abs(b.x - b.px), abs(b.y - b.py)) for b in back) < 1e-6 and all(0 <= b.ra < 360 for b in back)
    assert [p.path for p in survey.field_paths(spark.createDataFrame([(94, 1, 12, "r")], "run int, camcol int, field int, band string"), "%06d/%d/frame-%4$s-%3$04d.fits").collect()] == ["000094/1/frame-r-0012.fits"]


def _speed(x, y, gm=orbits.GM_SUN):
    return 0.5 * sum(v * v for v in y) - gm / math.sqrt(sum(v * v for v in x))


def test_elements_of_orbits(spark):
    r = np.random.default_rng(2)
    rows = [tuple(map(float, v)) for v in np.column_stack([r.uniform(0.3, 30, 300), r.uniform(0, 0.98, 300), r.uniform(0.01, 3.1, 300), *(r.uniform(0, 6.28, 300) for _ in range(3))])]
    rows += [(1.0, 0.0, 0.5, 1.0, 0.0, 2.0), (1.0, 0.3, 0.0, 0.0, 2.0, 2.0), (2.0, 0.5, math.pi, 0.0, 1.0, 0.1), (1.0, 0.0, 0.0, 0.0, 0.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, e double, i double, node double, peri double, mean double")
    states = orbits.with_states(df)
    for s, want in zip(states.collect(), rows, strict=True):
        x, v = (s.px, s.py, s.pz), (s.vx, s.vy, s.vz)
        assert np.allclose(x, orbits.position(*(np.array([w]) for w in want))[0], atol=1e-9 * want[0])
        assert abs(_speed(x, v) + orbits.GM_SUN / (2 * want[0])) < 1e-6 * orbits.GM_SUN / want[0]  # the energy of the orbit
    found = orbits.elements_of(states.select("px", "py", "pz", "vx", "vy", "vz"))
    again = orbits.with_states(found.select("a", "e", "i", "node", "peri", "mean", F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("pz").alias("qz"))).collect()
    assert all(np.allclose([g.px, g.py, g.pz], [g.qx, g.qy, g.qz], atol=1e-6 * g.a) for g in again)
    for g, w in list(zip(found.collect(), rows, strict=True))[:300]:
        assert np.allclose([g.a, g.e, g.i], w[:3], rtol=1e-6, atol=1e-7)
        if w[1] > 1e-3:
            assert all(abs(math.remainder(x - y, 2 * math.pi)) < 1e-5 for x, y in zip((g.node, g.peri, g.mean), w[3:], strict=True))
    free = spark.createDataFrame([(1.0, 0.0, 0.0, 0.0, 20.0, 0.0), (None, 0.0, 0.0, 0.0, 6.0, 0.0)], "px double, py double, pz double, vx double, vy double, vz double")
    assert all(x.a is None and x.mean is None for x in orbits.elements_of(free).collect())
    assert orbits.with_states(df.withColumn("e", F.lit(None).cast("double"))).first().px is None


def test_hints_of_jobs(spark):
    said = [
        (1, "default", "width", "1000", 0), (1, "default", "scale_low", "2", 0), (1, "default", "scale_high", "1", 0), (1, "option", "SCALE_units", "arcsecperpix", 0), (1, "header", "ra", "10", 0), (1, "header", "dec", "-5", 0), (1, "option", "cpu_limit", "999", 0),
        (2, "header", "width", "500", 0), (2, "option", "width", None, 0), (2, "option", "depth", "5", 0), (2, "option", "depth", "9", 3), (2, "option", "cpu_limit", "20", 0), (2, "option", "ra", "10h", 0),
        (3, "nobody", "width", "7", 0),
    ]
    df = spark.createDataFrame(said, "job long, source string, keyword string, value string, place int").repartition(5)
    j = {x.job: x for x in hints.job_table(df, {"min_width": 0.1, "max_width": 180.0, "cpu_limit": 300.0, "radius": 15.0}).collect()}
    assert (j[1].scale_low, j[1].scale_high, j[1].radius, j[1].cpu_limit, j[1].parity) == (1.0, 2.0, 15.0, 300.0, "both")
    assert (j[2].width, j[2].depth, j[2].cpu_limit, j[2].ra, j[2].radius) == (500.0, 9, 20.0, None, None) and abs(j[2].scale_low - 0.72) < 1e-12 and j[2].scale_high == 1296.0
    assert (j[3].width, j[3].scale_low, j[3].cpu_limit) == (None, None, 300.0)
    assert hints.job_table(df.limit(0), {"min_width": 0.1, "max_width": 180.0, "cpu_limit": 300.0, "radius": 15.0}).count() == 0


def test_fields_any_number_of_turns_away(spark):
    """a field's first degree of great-circle longitude may be several turns."""
    from skyweft import survey_queries
    from skyweft.functions import survey

    rows = spark.range(2000).selectExpr("id * 997 AS l_orderkey", "cast(id % 7 as int) AS l_linenumber")
    seen = spark.sql(survey_queries._SEEN.replace("FROM lineitem", "FROM {src}"), src=rows)
    back = survey.with_pixels(survey.with_sky(seen)).select("a", "x", "y", "px", "py").collect()
    assert len(back) == 2000 and max(r["a"] for r in back) > 3600
    assert all(abs(r["px"] - r["x"]) < 1e-6 and abs(r["py"] - r["y"]) < 1e-6 for r in back)
