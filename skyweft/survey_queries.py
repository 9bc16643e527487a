"""Queries of the registry for orbits, survey pixels and hints of jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyweft.catalog_queries import _frac, _read, query
from skyweft.functions import orbits, survey
from skyweft.operators import hints

_K = "o_orderkey"
_ELEMENTS = f"{_K} AS orbit, 0.5e0 + 5 * {_frac(_K, 0.7320508)} AS a, 0.01e0 + 0.9 * {_frac(_K, 0.2360679)} AS e, 0.05e0 + 3 * {_frac(_K, 0.4142135)} AS i, 6.2e0 * {_frac(_K, 0.6457513)} AS node, 6.2e0 * {_frac(_K, 0.3166247)} AS peri, 6.2e0 * {_frac(_K, 0.6055512)} AS mean"


@query(f"SELECT orbit, round(a, 5) AS a, round(e, 6) AS e, round(i, 6) AS i, round(node, 6) AS node, round(peri, 4) AS peri, round(mean, 4) AS mean FROM (SELECT {_ELEMENTS} FROM orders) o")
def orbit_elements(spark, sf):
    """Elements made places and velocities, and found again from those."""
    orders = spark.sql(f"SELECT {_ELEMENTS} FROM {{src}}", src=_read(spark, sf, "orders"))
    states = orbits.with_states(orders)
    got = orbits.elements_of(states.select("orbit", "px", "py", "pz", "vx", "vy", "vz"))
    return got.select("orbit", F.round("a", 5).alias("a"), *[F.round(c, n).alias(c) for c, n in (("e", 6), ("i", 6), ("node", 6), ("peri", 4), ("mean", 4))])


#: Calibrations of fields a little apart, and pixels of stars in them.
_FIELD = "cast(floor(l_orderkey / 50.0) as bigint)"
_CALIBRATION = {
    "a": f"10.0e0 + 0.15 * {_FIELD}", "b": "0.00011e0", "c": "0.0000002e0", "d": "-0.4e0", "e": "-0.0000003e0", "f": "0.00011e0", "d_row0": "0.02e0", "d_row1": "0.00001e0", "d_row2": "-0.00000003e0", "d_row3": "0.000000000007e0",
    "d_col0": "-0.05e0", "d_col1": "0.0002e0", "d_col2": "0.0000001e0", "d_col3": "-0.00000000003e0", "cs_row": "0.02e0", "cs_col": "-0.015e0", "cc_row": "0.04e0", "cc_col": "-0.03e0", "ri_cut": "1.5e0", "node": "95.0e0", "incl": "0.5e0 + l_linenumber",
}
_SEEN = f"SELECT l_orderkey, l_linenumber, {_FIELD} AS field, 2048 * {_frac('l_orderkey * 7 + l_linenumber', 0.7320508)} AS x, 1489 * {_frac('l_orderkey * 7 + l_linenumber', 0.2360679)} AS y, 3e0 * {_frac('l_orderkey * 7 + l_linenumber', 0.4142135)} AS colour, {', '.join(f'{e} AS {c}' for c, e in _CALIBRATION.items())} FROM lineitem"


def _seen(spark, sf):
    return spark.sql(_SEEN.replace("FROM lineitem", "FROM {src}"), src=_read(spark, sf, "lineitem"))


@query(f"SELECT l_orderkey, l_linenumber, round(x, 3) AS x, round(y, 3) AS y FROM ({_SEEN}) s")
def survey_round_trip(spark, sf):
    """Pixels of survey fields put on the sky and back, colours considered."""
    sky = survey.with_sky(_seen(spark, sf)).drop("x", "y")
    return survey.with_pixels(sky).select("l_orderkey", "l_linenumber", F.round("px", 3).alias("x"), F.round("py", 3).alias("y"))


@query(f"""SELECT l_orderkey, l_linenumber, round(((node + degrees(atan2(sin(m) * cos(n) * cos(radians(incl)) - sin(n) * sin(radians(incl)), cos(m) * cos(n)))) % 360 + 360) % 360, 6) AS ra, round(degrees(asin(sin(m) * cos(n) * sin(radians(incl)) + sin(n) * cos(radians(incl)))), 6) AS dec
  FROM (SELECT *, radians(a + b * r + c * k - node) AS m, radians(d + e * r + f * k) AS n FROM (
    SELECT *, y + d_row0 + d_row1 * x + d_row2 * x * x + d_row3 * x * x * x + CASE WHEN colour < ri_cut THEN cs_row * colour ELSE cc_row END AS r,
      x + d_col0 + d_col1 * x + d_col2 * x * x + d_col3 * x * x * x + CASE WHEN colour < ri_cut THEN cs_col * colour ELSE cc_col END AS k FROM ({_SEEN}) s) p) g""")
def survey_positions(spark, sf):
    """Positions of survey pixels on the sky."""
    return survey.with_sky(_seen(spark, sf)).select("l_orderkey", "l_linenumber", F.round("ra", 6).alias("ra"), F.round("dec", 6).alias("dec"))


_ENGINE = {"min_width": 0.1, "max_width": 180.0, "cpu_limit": 300.0, "radius": 15.0}


@query("""SELECT o_orderkey AS job, 1000.0e0 AS width, 800.0e0 AS height,
    CASE WHEN o_orderkey % 3 = 0 THEN least(o_custkey / 100e0, o_custkey / 50e0 + 1) * 60 / 1000 WHEN o_orderkey % 3 = 1 THEN o_custkey / 100e0 + 2 ELSE 0.36e0 END AS scale_low,
    CASE WHEN o_orderkey % 3 = 0 THEN greatest(o_custkey / 100e0, o_custkey / 50e0 + 1) * 60 / 1000 WHEN o_orderkey % 3 = 1 THEN o_custkey / 50e0 + 3 ELSE 648.0e0 END AS scale_high,
    CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 360 * 1e0 END AS ra, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 180 - 90e0 END AS dec,
    CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 2.5e0 ELSE 15.0e0 END END AS radius, cast(CASE WHEN o_orderkey % 5 = 0 THEN 40 ELSE 100 END as bigint) AS depth,
    CASE WHEN o_orderkey % 7 = 0 THEN 'pos' WHEN o_orderkey % 7 = 1 THEN 'neg' ELSE 'both' END AS parity, CASE WHEN o_custkey % 600 = 0 THEN 300e0 ELSE least(300e0, o_custkey % 600 * 1e0) END AS cpu_limit FROM orders""")
def job_hints(spark, sf):
    """What each job is to do, from options, headers and defaults; every second hint contradicted by a weaker source."""
    o = _read(spark, sf, "orders")
    h = lambda source, keyword, value, when="true", place=0: (source, keyword, value, when, place)
    said = [
        h("default", "WIDTH", "'1000'"), h("default", "height", "'800'"), h("default", "depth", "'100'"), h("header", "depth", "'40'", "o_orderkey % 5 = 0"), h("option", "depth", "cast(null as string)"),
        h("option", "scale_units", "'arcminwidth'", "o_orderkey % 3 = 0"), h("option", "scale_low", "cast(o_custkey / 50.0D + 1 as string)", "o_orderkey % 3 = 0"), h("option", "scale_high", "cast(o_custkey / 100.0D as string)", "o_orderkey % 3 = 0"),
        h("header", "scale_units", "'ArcsecPerPix'", "o_orderkey % 3 < 2"), h("header", "scale_low", "cast(o_custkey / 100.0D + 2 as string)", "o_orderkey % 3 < 2"), h("header", "scale_high", "cast(o_custkey / 50.0D + 3 as string)", "o_orderkey % 3 < 2"),
        h("header", "ra", "cast(o_custkey % 360 as string)", "o_orderkey % 2 = 0"), h("header", "dec", "cast(o_custkey % 180 - 90 as string)", "o_orderkey % 2 = 0"), h("default", "ra", "'12h'"), h("option", "radius", "'9'", "o_orderkey % 4 = 0", 0), h("option", "radius", "'2.5'", "o_orderkey % 4 = 0", 1), h("other", "radius", "'1'"),
        h("option", "parity", "'POS'", "o_orderkey % 7 = 0"), h("header", "parity", "'neg'", "o_orderkey % 7 < 2"), h("option", "cpu_limit", "cast(o_custkey % 600 as string)"),
    ]
    hint = F.array(*[F.when(F.expr(w), F.struct(F.lit(s).alias("source"), F.lit(k).alias("keyword"), F.expr(v).alias("value"), F.lit(p).alias("place"))) for s, k, v, w, p in said])
    rows = o.select(F.col("o_orderkey").alias("job"), "o_custkey", F.explode(F.filter(hint, lambda x: x.isNotNull())).alias("h")).select("job", "h.*")
    return hints.job_table(rows, _ENGINE)
