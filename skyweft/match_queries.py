"""More queries of the registry: catalogue cuts and lookups, match statistics, refinement, orbits."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from skyweft.catalog_queries import CUSTOMERS, D3, POINTS, SUPPLIERS, TAN, _chord2, _frac, _read, customers, points, query, suppliers
from skyweft.functions import geometry, healpix, orbits, sky, wcs
from skyweft.functions.sky import num
from skyweft.operators import catalogs, match_stats, spatial, web
from skyweft.plans import build_index, tweak
from skyweft.session import scratch_dir
from skyweft.streaming import jobs

_PX, _PY = wcs.sky_to_pixel(TAN, "x", "y", "z")


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size <> 0 AND p_partkey % 5 = 0")
def quality_cut(spark, sf):
    """Rows of known quality and without contamination."""
    p = _read(spark, sf, "part").withColumn("cc", F.expr("p_partkey % 5"))
    return catalogs.quality_cut(p, "p_size", "cc", ["p_partkey", "p_size", "p_retailprice"])


@query("SELECT vec_id, round(list_avg([cast(v as double) for v in embedding if v > 0]), 6) AS mag FROM embeddings")
def mean_magnitudes(spark, sf):
    """Mean of the known entries of an array."""
    return _read(spark, sf, "embeddings").select("vec_id", F.round(catalogs.mean_magnitude("embedding"), 6).alias("mag"))


@query(f"SELECT id, mag FROM {CUSTOMERS} s WHERE (ra >= 350 OR ra <= 15) AND dec BETWEEN -30 AND 45 AND mag <= 5000")
def box_across_zero(spark, sf):
    """A box across RA 0 with a magnitude limit."""
    return catalogs.box_query(customers(spark, sf), (350.0, 15.0), (-30.0, 45.0), "mag", 5000.0).select("id", "mag")


@query(f"SELECT a.id, round(coalesce(b.ra, a.ra), 9) AS ra, round(coalesce(b.dec, a.dec), 9) AS dec FROM {CUSTOMERS} a LEFT JOIN {SUPPLIERS} b ON a.id = b.id")
def accurate_positions(spark, sf):
    """Rough positions replaced by accurate ones where there are any."""
    out = catalogs.accurate_positions(customers(spark, sf).select("id", "ra", "dec"), suppliers(spark, sf), ["id"])
    return out.select("id", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"))


@query("SELECT n_nationkey, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS names FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY n_nationkey")
def object_names(spark, sf):
    """All names of each object."""
    names = _read(spark, sf, "customer").where("c_acctbal > 9000").selectExpr("c_nationkey AS n_nationkey", "c_mktsegment AS name")
    return catalogs.with_names(_read(spark, sf, "nation").select("n_nationkey"), names, ["n_nationkey"]).select("n_nationkey", F.array_join("names", ",").alias("names"))


def _in_field(kind: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, concat('{kind} ', cast(id AS VARCHAR)) AS name, px, py, mag FROM (SELECT id, mag, {_PX} AS px, {_PY} AS py FROM {source} s) p WHERE {wcs.in_image(TAN, 'px', 'py')}"


@query(f"SELECT kind, name, round(px, 6) AS px, round(py, 6) AS py, mag FROM ({_in_field('C', CUSTOMERS)} UNION ALL {_in_field('S', SUPPLIERS)}) u ORDER BY mag, name LIMIT 15")
def field_annotations(spark, sf):
    """The brightest named objects of two catalogues in a field; a third one only counts in small fields."""
    named = lambda df, k: df.withColumn("name", F.concat(F.lit(k + " "), F.col("id").cast("string")))
    c, s = customers(spark, sf), suppliers(spark, sf)
    out = catalogs.annotations({"C": (named(c, "C"), None), "S": (named(s, "S"), 20.0), "X": (named(s, "X"), 1.0)}, TAN, 13.0, 15)
    return out.select("kind", "name", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"), "mag")


@query(f"SELECT a.id, round({sky.deg_of_chord2(D3)}, 6) AS dist_deg FROM {CUSTOMERS} a JOIN (SELECT cos(radians(-10.0)) * cos(radians(200.0)) AS x, cos(radians(-10.0)) * sin(radians(200.0)) AS y, sin(radians(-10.0)) AS z) b ON {D3} <= {_chord2(20.0)} AND {sky.deg_of_chord2(D3)} >= 10")
def annulus(spark, sf):
    """Stars at ten to twenty degrees from a place."""
    return catalogs.within_annulus(customers(spark, sf), 200.0, -10.0, 10.0, 20.0).select("id", F.round("dist_deg", 6).alias("dist_deg"))


@query(f"SELECT round(min(x), 9) AS x0, round(max(x), 9) AS x1, round(min(y), 9) AS y0, round(max(y), 9) AS y1 FROM {POINTS} p")
def bounding_box(spark, sf):
    """Bounds of the points."""
    return catalogs.bounding_box(points(spark, sf), "x", "y").select(*[F.round(c, 9).alias(c) for c in ("x0", "x1", "y0", "y1")])


_MOVED = f"(SELECT id, x + 1.3 AS x, y - 0.7 AS y FROM {POINTS} p WHERE id % 2 = 0)"
_VOTE = "greatest(0, least(19, cast(floor(({v} + 2.0) / 0.2) as bigint)))"


@query(f"""SELECT cast(round(bx * 0.2 - 2.0 + 0.1, 6) as double) AS dx, cast(round(iy * 0.2 - 2.0 + 0.1, 6) as double) AS dy, votes FROM (SELECT {_VOTE.format(v='(b.x - a.x)')} AS bx, {_VOTE.format(v='(b.y - a.y)')} AS iy, count(*) AS votes
  FROM {POINTS} a JOIN {_MOVED} b ON abs(b.x - a.x) <= 2 AND abs(b.y - a.y) <= 2 GROUP BY 1, 2) v ORDER BY votes DESC, bx, iy LIMIT 1""")
def shift_votes(spark, sf):
    """The shift between two lists of points, by votes of pairs."""
    p = points(spark, sf)
    out = match_stats.shift_by_votes(p, p.where("id % 2 = 0").selectExpr("id", "x + 1.3D AS x", "y - 0.7D AS y"), 2.0, 0.2)
    return out.select(F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"), "votes")


@query("SELECT l_returnflag, round(avg(sqrt(l_tax)), 9) AS mean, round(sqrt(avg(l_tax)), 9) AS rms, round(sqrt(sum(l_quantity * l_tax) / sum(l_quantity)), 9) AS wrms FROM lineitem GROUP BY l_returnflag")
def residual_statistics(spark, sf):
    """Mean, rms and weighted rms of residuals by group."""
    r = match_stats.residuals(_read(spark, sf, "lineitem"), "l_tax", "l_quantity", ["l_returnflag"])
    return r.select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("mean", "rms", "wrms")])


@query("SELECT user_id, count(*) FILTER (l >= 0) AS n_match, count(*) FILTER (l = -2) AS n_conflict, count(*) FILTER (l = -1) AS n_distract FROM (SELECT user_id, event_id % 5 - 2 AS l FROM events) e GROUP BY user_id")
def label_counts(spark, sf):
    """Matches, conflicts and distractors of each match."""
    return match_stats.match_labels(_read(spark, sf, "events").selectExpr("user_id", "event_id % 5 - 2 AS label"), "user_id")


_TRUTH = f"(SELECT id % 50 AS field, x, y, z, row_number() OVER (PARTITION BY id % 50 ORDER BY mag, id) - 1 AS rank FROM {CUSTOMERS} t0)"
_CLAIM = f"(SELECT id % 50 AS field, id, x, y, z, 1.5 + {_frac('id', 0.77)} * 2 AS r2 FROM {SUPPLIERS} m0)"


@query(f"SELECT m.id, bool_and({sky.dist2('m', 't')} <= 1.2 * m.r2) AS correct FROM {_CLAIM} m LEFT JOIN {_TRUTH} t ON m.field = t.field AND t.rank < 3 GROUP BY m.id")
def certify(spark, sf):
    """Matches whose field's first true places all lie inside."""
    m = suppliers(spark, sf).selectExpr("id % 50 AS field", "id", "x", "y", "z", f"1.5 + {_frac('id', 0.77)} * 2 AS r2")
    from pyspark.sql import Window

    t = customers(spark, sf).selectExpr("id % 50 AS field", "x", "y", "z", "mag", "id").withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy("mag", "id")) - 1)
    return match_stats.certify(m, t, "field", 3).select("id", "correct")


@query("SELECT user_id AS field, bool_or(value > 150) AS solved FROM events GROUP BY user_id")
def merge_solved(spark, sf):
    """A field is solved if any run solved it."""
    return match_stats.merge_solved(_read(spark, sf, "events").selectExpr("user_id AS field", "value > 150 AS solved"))


@query("SELECT sha1(text) AS file_hash, min(cast(doc_id AS VARCHAR)) AS path, count(*) AS copies FROM documents GROUP BY 1")
def unique_files(spark, sf):
    """Submissions by the digest of their content."""
    return match_stats.unique_files(_read(spark, sf, "documents").selectExpr("cast(doc_id AS string) AS path", "text AS content"))


@query(f"SELECT greatest(0, least(9, cast(floor((sqrt({D3}) - 0.0) / 0.01) as bigint))) AS bin, count(*) AS n FROM {CUSTOMERS} a JOIN {CUSTOMERS} b ON a.id < b.id AND {D3} <= {num(0.1**2)} GROUP BY 1")
def pair_separations(spark, sf):
    """Histogram of pair distances on the sphere."""
    return match_stats.separation_histogram(customers(spark, sf), 0.1, 0.01)


_FOOT = f"(SELECT id, x, y, z, 6 + 6 * {_frac('id', 0.31)} AS r FROM {SUPPLIERS} f0)"


@query(f"SELECT a.id AS a, b.id AS b FROM {_FOOT} a JOIN {_FOOT} b ON a.id < b.id AND {sky.deg_of_chord2(D3)} <= a.r + b.r")
def footprint_overlaps(spark, sf):
    """Pairs of circular footprints that meet."""
    return match_stats.overlapping_footprints(suppliers(spark, sf).selectExpr("id", "x", "y", "z", f"6 + 6 * {_frac('id', 0.31)} AS r"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = e.user_id AND o.o_orderkey = e.event_id)")
def free_stars(spark, sf):
    """Field stars that are not members of the match."""
    used = _read(spark, sf, "orders").selectExpr("o_custkey AS user_id", "o_orderkey AS event_id")
    return match_stats.free_stars(_read(spark, sf, "events").select("user_id", "event_id"), used, ["user_id", "event_id"]).select("event_id")


@query()
def feature_sizes(spark, sf):
    """Angles, midpoints and faintest members of an index's features."""
    index = build_index.build_index(customers(spark, sf).select("id", "ra", "dec", "mag"), "id", "ra", "dec", "mag", (180.0, 900.0), nside=4)
    return match_stats.feature_sizes(index.quads, index.stars)


@query()
def refined_projection(spark, sf):
    """A distorted projection is recovered from matched stars; its coefficients as rows."""
    true = wcs.Tan((120.0, 30.0), (500.0, 400.0), (-0.02, 0.005, 0.005, 0.02), (1000.0, 800.0), {(2, 0): 2e-5, (1, 1): -1e-5}, {(0, 2): 1e-5})
    x, y, z = wcs.pixel_to_xyz(true, "px", "py")
    matched = points(spark, sf).selectExpr("x * 10 AS px", "y * 8 AS py").select("px", "py", F.expr(x).alias("x"), F.expr(y).alias("y"), F.expr(z).alias("z"))
    got = tweak.fit_polynomial(matched, wcs.Tan((120.0, 30.0), (500.0, 400.0), (-0.02, 0.005, 0.005, 0.02)), 2)
    rows = [("cd", i, 0, float(v)) for i, v in enumerate(got.cd)] + [(n, p, q, float(v)) for n, d in (("a", got.a), ("b", got.b)) for (p, q), v in d.items()]
    return spark.createDataFrame(rows, "part string, p int, q int, value double").select("part", "p", "q", F.round("value", 9).alias("value"))


_ORBITS = f"(SELECT id, 1.0 + id % 5 AS a, {_frac('id', 0.11)} * 0.9 AS e, {_frac('id', 0.23)} * {math.pi} AS i, {_frac('id', 0.37)} * {2 * math.pi} AS node, {_frac('id', 0.41)} * {2 * math.pi} AS peri, {_frac('id', 0.53)} * {2 * math.pi} AS mean FROM {CUSTOMERS} c0)"
_ANOMALY = f"""(SELECT *, list_reduce(list_transform(range(60), lambda k: CAST(m AS DOUBLE)), lambda v, k: greatest(m - e, least(m + e, v - (v - e * sin(v) - m) / (1 - e * cos(v)))), m + e * sin(m)) AS big
  FROM (SELECT *, CASE WHEN mean >= {math.pi} THEN mean - {2 * math.pi} ELSE mean END AS m FROM {_ORBITS} o0) o1)"""


@query(f"""SELECT id, round(p * (cos(node) * cos(peri) - sin(node) * sin(peri) * cos(i)) - q * (cos(node) * sin(peri) + sin(node) * cos(peri) * cos(i)), 6) AS px,
  round(p * (sin(node) * cos(peri) + cos(node) * sin(peri) * cos(i)) - q * (sin(node) * sin(peri) - cos(node) * cos(peri) * cos(i)), 6) AS py, round(p * sin(peri) * sin(i) + q * cos(peri) * sin(i), 6) AS pz
  FROM (SELECT *, a * (cos(big) - e) AS p, a * sqrt(1 - e * e) * sin(big) AS q FROM {_ANOMALY} o2) o3""")
def orbit_positions(spark, sf):
    """Positions of bodies on Kepler orbits."""
    turn = 2 * math.pi
    e = customers(spark, sf).selectExpr("id", "1.0D + id % 5 AS a", f"{_frac('id', 0.11)} * 0.9 AS e", f"{_frac('id', 0.23)} * {math.pi} AS i", f"{_frac('id', 0.37)} * {turn} AS node", f"{_frac('id', 0.41)} * {turn} AS peri", f"{_frac('id', 0.53)} * {turn} AS mean")
    return orbits.with_positions(e).select("id", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")])


_S, _T = ("a.x", "a.y", "a.x + 8", "a.y + 3"), ("b.x", "b.y", "b.x - 2", "b.y + 9")
_LX, _LY = geometry.line_crossing(_S, _T)


@query(f"SELECT a.id AS a, b.id AS b, round({_LX}, 6) AS x, round({_LY}, 6) AS y FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND {geometry.segments_cross(_S, _T)}")
def segment_crossings(spark, sf):
    """Where the segments of points cross those of later points."""
    p = points(spark, sf)
    out = spatial.segment_crossings(p.selectExpr("id", "x AS x0", "y AS y0", "x + 8 AS x1", "y + 3 AS y1"), p.selectExpr("id", "x AS x0", "y AS y0", "x - 2 AS x1", "y + 9 AS y1"), 4.0, ordered=True)
    return out.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_V0, _V1 = "(y + 30 - 1.5 * greatest(0, 40 - x) - greatest(40, y))", "(y + 30 - 1.5 * least(20, 60 - x) - greatest(40, y))"
_UNDER = "CASE WHEN {v} <= 0 THEN 0 WHEN {v} <= h THEN {v} * {v} / 2 ELSE h * h / 2 + h * ({v} - h) END"


@query(f"""SELECT id, round(CASE WHEN h <= 0 OR x + 20 <= 40 OR x >= 60 THEN 0 ELSE (({_UNDER.format(v=_V0)}) - ({_UNDER.format(v=_V1)})) / 1.5 END, 6) AS area
  FROM (SELECT *, 60 - greatest(40, y) AS h FROM {POINTS} p) q""")
def polygon_overlaps(spark, sf):
    """Areas that triangles share with a square; the SQL integrates the triangle's height over the square."""
    p = points(spark, sf).selectExpr("id", "array(array(x, y), array(x + 20, y), array(x, y + 30)) AS a", "array(array(40D, 40D), array(60D, 40D), array(60D, 60D), array(40D, 60D)) AS b")
    return geometry.overlap_areas(p, "a", "b").select("id", F.round("area", 6).alias("area"))


#: Cell 77 of the grid of 4 with all cells that touch it, its parent, and the children of the former.
_NEAR, _PARENT = [0, 1, 2, 72, 73, 74, 76, 77, 78], 18
_CHILDREN = [c // 16 * 64 + (c % 16 // 4 * 2 + i) * 8 + c % 4 * 2 + j for c in _NEAR for i in (0, 1) for j in (0, 1)]
_listed = lambda cells: ", ".join(map(str, cells))
_PLACED = " UNION ALL ".join(f"SELECT id, {n} AS nside, cell FROM {healpix.cell_sql(CUSTOMERS, n, 'id')} h{n} WHERE id % 3 = {k}" for k, n in enumerate((2, 4, 8)))


@query(f"SELECT id, nside, cell FROM ({_PLACED}) p WHERE nside = 4 AND cell IN ({_listed(_NEAR)}) OR nside = 2 AND cell = {_PARENT} OR nside = 8 AND cell IN ({_listed(_CHILDREN)})")
def nearby_images(spark, sf):
    """Images in or beside a cell, in its parent or its children."""
    s = customers(spark, sf)
    placed = [healpix.with_cell(s, n).selectExpr("id", f"{n} AS nside", "cell").where(f"id % 3 = {k}") for k, n in enumerate((2, 4, 8))]
    return web.nearby_images(placed[0].unionByName(placed[1]).unionByName(placed[2]), 77, 4)


@query("SELECT cast(floor(epoch(ts) / 600) * 600 as bigint) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Ten-minute windows of a stream of events, after it has run dry."""
    base = f"{scratch_dir(spark)}/windows-{uuid.uuid4().hex}"
    events = _read(spark, sf, "events").select("ts", "event_type", "value")
    events.repartition(4).write.parquet(f"{base}/in")
    counts = jobs.windowed_counts(jobs.job_stream(spark, f"{base}/in", events.schema, 2), "ts", "event_type", "value")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))
