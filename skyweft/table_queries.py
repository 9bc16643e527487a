"""Queries of the registry for table tools, sinks, saved indexes, images and checks of fields."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skyweft import catalog_queries
from skyweft.catalog_queries import CELL4, CUSTOMERS, FIELDS, NORMAL_SQL, ORACLE_SQL, PIXELS_SQL, POINTS, TAN, _chord2, _pixels, _frac, _read, customers, fields, points, query
from skyweft.functions import sky, wcs
from skyweft.functions.sky import num
from skyweft.operators import images, match_stats, quads, spatial, table
from skyweft.plans import build_index, saved_index
from skyweft.session import scratch_dir, shuffle_partitions
from skyweft.sources import fits, packed, text

# ---- sinks ---------------------------------------------------------------------------------------


@query(f"SELECT id, round(ra, 9) AS ra, round(dec, 9) AS dec, mag, id % 2 = 0 AS even FROM {CUSTOMERS} s UNION ALL SELECT id + 1000000, round(ra, 9), round(dec, 9), mag, id % 2 = 0 FROM {CUSTOMERS} s WHERE id <= 100")
def written_table(spark, sf):
    """Stars written as a folder of binary tables, some appended under other numbers, read back."""
    fits.register(spark)
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    s = customers(spark, sf).selectExpr("id", "ra", "dec", "mag", "id % 2 = 0 AS even")
    s.write.format("skytable").mode("append").save(path)
    s.where("id <= 100").selectExpr("id + 1000000 AS id", "ra", "dec", "mag", "even").write.format("skytable").mode("append").save(path)
    return spark.read.format("skytable").load(path).select("id", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"), "mag", "even")


@query(f"SELECT cast(floor((z + 1) * 2) as bigint) AS tile, id, CASE WHEN id % 2 = 0 THEN 'even' ELSE 'odd' END AS source, id AS found FROM {CUSTOMERS} s")
def tile_files(spark, sf):
    """Stars of two inputs in a folder of files a band of height; each row of each tile is found again in the input by its file and number."""
    fits.register(spark)
    root = f"{scratch_dir(spark)}/tiles-{uuid.uuid4().hex}"
    s = customers(spark, sf).select("id", "z")
    for name, rest in (("even", 0), ("odd", 1)):
        s.where(f"id % 2 = {rest}").write.format("skytable").mode("append").save(f"{root}/{name}")
    raw = [spark.read.format("skytable").option("provenance", "true").load(f"{root}/{name}") for name in ("even", "odd")]
    raw = raw[0].unionByName(raw[1])
    saved_index.write_tiles(raw.selectExpr("id", "cast(floor((z + 1) * 2) as bigint) AS tile", "backref_file", "backref_index"), f"{root}/tiles")
    tiles = spark.read.parquet(f"{root}/tiles").withColumn("tile", F.col("tile").cast("long"))
    back = saved_index.copied_rows(raw.select("backref_file", "backref_index", F.col("id").alias("found")), tiles.withColumnRenamed("id", "place"))
    return tiles.join(back.withColumnRenamed("place", "id"), ["backref_file", "backref_index", "id"]).select("tile", "id", F.regexp_extract("backref_file", "/(even|odd)/", 1).alias("source"), "found")


@query(f"SELECT field, id, round(x, 6) AS x, round(y, 6) AS y, rank FROM {FIELDS} f")
def field_files(spark, sf):
    """A file a field with its stars and their pairs as two tables; the stars read back from all files."""
    return _field_files(spark, sf, 1).select("field", "id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "rank")


@query(f"SELECT a.field, a.id AS l_id, b.id AS r_id FROM {FIELDS} a JOIN {FIELDS} b ON a.field = b.field AND a.rank + 1 = b.rank")
def field_file_pairs(spark, sf):
    """The second table of every field's file: neighbours by brightness."""
    return _field_files(spark, sf, 2).select("field", "l_id", "r_id")


@query(f"SELECT field, count(*) AS n_stars, 'field ' || field AS object FROM {FIELDS} f GROUP BY field")
def field_file_headers(spark, sf):
    """What the headers of the fields' files say."""
    cards = spark.read.format("skyheader").load(_written_fields(spark, sf)).where("extension = 0 AND name IN ('NSTARS', 'OBJECT')")
    of = cards.groupBy(F.regexp_extract("file", "field-([0-9]+)[.]fits$", 1).cast("long").alias("field"))
    pick = lambda k: F.max(F.when(F.col("name") == k, F.col("value")))
    return of.agg(pick("NSTARS").cast("long").alias("n_stars"), pick("OBJECT").alias("object"))


def _written_fields(spark, sf) -> str:
    fits.register(spark)
    path = f"{scratch_dir(spark)}/fields-{uuid.uuid4().hex}"
    f = fields(spark, sf)
    stars = f.groupBy("field").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "x", "y"))).alias("stars"))  # ten a field
    pairs = F.transform(F.sequence(F.lit(1), F.size("stars") - 1), lambda k: F.struct(F.col("stars")[k - 1]["id"].alias("l_id"), F.col("stars")[k]["id"].alias("r_id")))
    header = F.create_map(F.lit("NSTARS"), F.size("stars").cast("string"), F.lit("OBJECT"), F.concat(F.lit("field "), F.col("field").cast("string")))
    rows = stars.select(F.concat(F.lit("field-"), F.col("field").cast("string")).alias("name"), header.alias("header"), "stars", F.when(F.size("stars") > 1, pairs).alias("pairs"))
    rows.repartition(shuffle_partitions(spark), "name").write.format("skyfiles").mode("append").save(path)  # files are work that their bytes don't show
    return path


def _field_files(spark, sf, extension: int):
    t = spark.read.format("skytable").option("ext", extension).option("provenance", "true").load(_written_fields(spark, sf))
    return t.withColumn("field", F.regexp_extract("backref_file", "field-([0-9]+)[.]fits$", 1).cast("long"))


@query(f"""SELECT id, round(floor(ra * 360000) / 360000, 9) AS ra, round(floor((dec + 90) * 360000) / 360000 - 90, 9) AS dec, round(0.002e0 * (id % 9000 - 4000), 6) AS pm_ra, cast(id % 6 as integer) AS detections,
  id % 7 = 0 AS spike, round(1950 + 0.1e0 * (id % 500), 6) AS epoch, round(0.01e0 * (id % 2500), 6) AS first_mag, cast(id % 900 as integer) AS last_field FROM {CUSTOMERS} s""")
def packed_catalog(spark, sf):
    """Stars packed as digits of binary records, in several files that are read by ranges of records, and taken apart again."""
    s = customers(spark, sf).selectExpr("id", "cast(floor(ra * 360000) as bigint) AS w0", "cast(floor((dec + 90) * 360000) as bigint) AS w1", "id % 9000 + 1000 AS a_pm_ra", "5000 AS a_pm_spd", "3 AS a_pm_prob", "1 AS a_moving",
        "12 AS b_pm_ra", "34 AS b_pm_spd", "5 AS b_fit_ra", "6 AS b_fit_spd", "id % 6 AS b_detections", "if(id % 7 = 0, 1, 0) AS b_spike", "7 AS c_ra", "8 AS c_spd", "id % 500 AS c_epoch", "0 AS c_ys4", "id % 2500 AS mag", "id % 900 AS field", "2 AS survey", "11 AS star_galaxy", "5100 AS xi", "4900 AS eta", "1 AS calibration")
    words = s.select("w0", "w1", packed.pack_digits(packed.USNOB_MOTION).alias("w2"), packed.pack_digits(packed.USNOB_ERRORS).alias("w3"), packed.pack_digits(packed.USNOB_EPOCH).alias("w4"), *[packed.pack_digits(packed.USNOB_MAGNITUDE).alias(f"w{5 + k}") for k in range(5)], *[packed.pack_digits(packed.USNOB_RESIDUAL).alias(f"w{10 + k}") for k in range(5)], F.col("id").alias("w15"), *[F.lit(k).cast("long").alias(f"w{15 + k}") for k in range(1, 5)])
    path = f"{scratch_dir(spark)}/packed-{uuid.uuid4().hex}"
    packed.write_records(words.repartition(3), path, packed.USNOB_FIELDS, packed.USNOB_RECORD)
    t = packed.read_usnob(spark, path, records=200)
    r = lambda c, n: F.round(c, n)
    return t.select(F.col("obs")[0]["scan"].alias("id"), r("ra", 9).alias("ra"), r("dec", 9).alias("dec"), r("pm_ra", 6).alias("pm_ra"), "detections", "spike", r("epoch", 6).alias("epoch"), r(F.col("obs")[0]["mag"], 6).alias("first_mag"), F.col("obs")[4]["field"].alias("last_field"))


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS v FROM supplier")
def struct_text_round_trip(spark, sf):
    """Rows written as struct text and read back."""
    path = f"{scratch_dir(spark)}/struct-{uuid.uuid4().hex}"
    text.write_struct_text(_read(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS v"), path, "supplier")
    return text.read_struct_text(spark, path, "SUPPLIER")


@query(f"SELECT image, count(*) AS n, round(sum(value), 4) AS total, round(sum(value * x), 4) AS across, round(sum(value * y), 4) AS down FROM {PIXELS_SQL} p GROUP BY image")
def image_file(spark, sf):
    """Images written by tasks, a file each, and read by ranges of rows; without their missing pixels."""
    fits.register(spark)
    path = f"{scratch_dir(spark)}/images-{uuid.uuid4().hex}"
    fits.write_images(_pixels(spark, sf), path)
    got = spark.read.format("skyimage").option("rows", 5).load(path).withColumn("image", F.regexp_extract("file", "image-([0-9]+)[.]fits$", 1).cast("long"))
    return got.groupBy("image").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.sum(F.col("value") * F.col("x")), 4).alias("across"), F.round(F.sum(F.col("value") * F.col("y")), 4).alias("down"))


# ---- saved indexes -------------------------------------------------------------------------------


def _index(spark, sf, low: float = 180.0, high: float = 900.0):
    return build_index.build_index(customers(spark, sf).select("id", "ra", "dec", "mag"), "id", "ra", "dec", "mag", (low, high), nside=4)


_TOP = f"(SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY cell ORDER BY mag, id) AS k FROM {CELL4} c) r WHERE k <= 10)"


@query(f"SELECT 7 AS index_id, -1 AS healpix, 4 AS nside, cast(180 as double) AS scale_lower, cast(900 as double) AS scale_upper, count(*) AS n_stars FROM {_TOP}")
def index_list(spark, sf):
    """An index is saved, and found again by its metadata alone."""
    root = f"{scratch_dir(spark)}/indexes-{uuid.uuid4().hex}"
    saved_index.save_index(_index(spark, sf), f"{root}/seven", 7, nside=4)
    return saved_index.list_indexes(spark, root).select("index_id", "healpix", "nside", "scale_lower", "scale_upper", "n_stars")


#: Points as stars of an index in cells of 25 x 25, and the fields' features as its features.
_STARS = f"(SELECT id, x AS ra, y AS dec, flux AS mag, least(3, cast(floor(x / 25) as bigint)) * 4 + least(3, cast(floor(y / 25) as bigint)) AS cell FROM {POINTS} p1)"
_FEATURES = f"(SELECT field * 10000 + a % 10 * 1000 + b % 10 * 100 + c % 10 * 10 + d % 10 AS quad_id, a, b, c, d, cx, cy, dx, dy FROM {NORMAL_SQL} n1)"


def _fixed_index(spark, sf) -> build_index.Index:
    stars = points(spark, sf).selectExpr("id", "x AS ra", "y AS dec", "flux AS mag", "least(3, cast(floor(x / 25) as bigint)) * 4 + least(3, cast(floor(y / 25) as bigint)) AS cell")
    features = catalog_queries._quads(spark, sf).selectExpr("field * 10000 + a % 10 * 1000 + b % 10 * 100 + c % 10 * 10 + d % 10 AS quad_id", "a", "b", "c", "d", "cx", "cy", "dx", "dy")
    return build_index.Index(stars, features, 2.0, 4.0)


@query(f"SELECT quad_id, a AS star_a, d AS star_d, round(p.ra, 6) AS ra_a, round(p.dec, 6) AS dec_a, round(q.ra, 6) AS ra_b, round(r.dec, 6) AS dec_c, round(s.ra, 6) AS ra_d FROM {_FEATURES} f JOIN {_STARS} p ON a = p.id JOIN {_STARS} q ON b = q.id JOIN {_STARS} r ON c = r.id JOIN {_STARS} s ON d = s.id")
def index_round_trip(spark, sf):
    """An index is saved, loaded, and flattened to a row a feature with the places of its stars."""
    root = f"{scratch_dir(spark)}/indexes-{uuid.uuid4().hex}"
    saved_index.save_index(_fixed_index(spark, sf), f"{root}/one", 1, nside=4)
    flat = saved_index.flat_table(saved_index.load_index(spark, f"{root}/one"))
    return flat.select("quad_id", "star_a", "star_d", *[F.round(c, 6).alias(c) for c in ("ra_a", "dec_a", "ra_b", "dec_c", "ra_d")])


@query(f"SELECT quad_id, round(cx, 9) AS cx, round(dy, 9) AS dy, 'part-' || CASE WHEN cx <= 0.3 THEN 1 ELSE 2 END AS folder FROM {_FEATURES} f WHERE cx <= 0.3 OR cx >= 0.1 AND cx > 0.3")
def index_parts(spark, sf):
    """Two overlapping parts of an index are saved with the stars shared, opened together, and merged: every feature once, with the part that has it."""
    root, whole = f"{scratch_dir(spark)}/indexes-{uuid.uuid4().hex}", _fixed_index(spark, sf)
    part = lambda c: build_index.Index(whole.stars, whole.quads.where(c), 2.0, 4.0)
    saved_index.save_index(part("cx <= 0.3"), f"{root}/part-1", 1)
    saved_index.save_index(part("cx >= 0.1"), f"{root}/part-2", 2, stars_at=f"{root}/part-1")
    folders = [f"{root}/part-1", f"{root}/part-2"]
    _, tagged = saved_index.open_indexes(spark, folders)
    merged = saved_index.merge_indexes([saved_index.load_index(spark, f) for f in folders]).quads
    first = tagged.groupBy("quad_id").agg(F.min(F.regexp_extract("folder", "part-[12]$", 0)).alias("folder"))
    return merged.join(first, "quad_id").select("quad_id", F.round("cx", 9).alias("cx"), F.round("dy", 9).alias("dy"), "folder")


# ---- table tools ---------------------------------------------------------------------------------


@query(f"SELECT id, sweep, mag FROM (SELECT id, mag, cast(row_number() OVER (PARTITION BY cell ORDER BY mag, id) - 1 as bigint) AS sweep FROM {CELL4} c) s WHERE sweep < 2 ORDER BY sweep, mag, id")
def sweep_order(spark, sf):
    """Two sweeps of the sky, brightest first within each."""
    from skyweft.functions import healpix
    from skyweft.operators import uniformize

    top = uniformize.uniformize_top(healpix.with_cell(customers(spark, sf), 4), "cell", [F.col("mag"), F.col("id")], 2)
    return table.sweep_order(top.select("id", F.col("sweep").cast("long").alias("sweep"), "mag"), "sweep", "mag", "id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND NOT (l_tax = 0 OR l_returnflag = 'R')")
def filter_rows(spark, sf):
    """Rows by an expression in the C manner."""
    return table.filter_rows(_read(spark, sf, "lineitem"), "l_quantity > 45 && !(l_tax == 0 || l_returnflag == 'R')").select("l_orderkey", "l_linenumber")


@query("SELECT r_name AS name, CASE r_name WHEN 'ASIA' THEN 'new' ELSE cast(r_regionkey as varchar) END AS value FROM region WHERE r_name <> 'EUROPE' UNION ALL SELECT 'MOON', 'far'")
def edit_header(spark, sf):
    """A keyword set, one removed, one added."""
    h = _read(spark, sf, "region").selectExpr("r_name AS name", "cast(r_regionkey as string) AS value")
    return table.edit_header(h, {"asia": "new", "EUROPE": None, "MOON": "far"})


@query("SELECT p.position, c.c_custkey AS id, c.c_acctbal AS balance FROM (SELECT unnest([0, 1, 2]) AS position, unnest([8, 3, 8]) AS pick) p JOIN customer c ON c.c_custkey = p.pick")
def read_as(spark, sf):
    """Some columns of some rows under other names."""
    c = _read(spark, sf, "customer").withColumnsRenamed({"c_custkey": "C_CustKey"})
    return table.read_as(c, {"c_custkey": "id", "c_acctbal": "balance"}, rows=("id", [8, 3, 8]), columns=["id", "balance"])


@query("SELECT p.position, cast(e.embedding[1] as double) AS v0, cast(e.embedding[2] as double) AS v1 FROM (SELECT unnest([0, 1, 2]) AS position, unnest([5, 1, 5]) AS pick) p JOIN embeddings e ON e.vec_id = p.pick")
def gather_arrays(spark, sf):
    """Entries of the arrays of a list of rows."""
    picks = spark.range(1).select(F.posexplode(F.lit([5, 1, 5]).cast("array<long>")).alias("position", "pick"))
    got = table.gather_arrays(_read(spark, sf, "embeddings"), "vec_id", picks, "pick", "embedding", 2)
    return got.select("position", *[F.col(c).cast("double").alias(c) for c in ("v0", "v1")])


@query("SELECT c_custkey AS k, 'first' AS survey FROM customer UNION ALL SELECT s_suppkey, 'first' FROM supplier")
def merge_constants(spark, sf):
    """Two tables of which the first one's constant holds for all rows."""
    a = _read(spark, sf, "customer").selectExpr("c_custkey AS k", "'first' AS survey")
    return table.with_constants([a, _read(spark, sf, "supplier").selectExpr("s_suppkey AS k", "'second' AS survey")], ["survey"])


@query("SELECT l_returnflag, c AS column, count(v) AS n, min(v) AS low, max(v) AS high, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS spread FROM (SELECT l_returnflag, unnest(['l_quantity', 'l_tax']) AS c, unnest([l_quantity, l_tax]) AS v FROM lineitem) s GROUP BY 1, 2")
def column_statistics(spark, sf):
    """Ranges, means and spreads of columns."""
    s = table.column_statistics(_read(spark, sf, "lineitem"), ["l_quantity", "l_tax"], ["l_returnflag"])
    return s.select("l_returnflag", "column", "n", "low", "high", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


# ---- images --------------------------------------------------------------------------------------


@query(f"SELECT image, cast(floor(x / 6.0) as bigint) AS bx, cast(floor(y / 6.0) as bigint) AS iy, round(CASE WHEN sum(x % 3) <> 0 THEN sum(x % 3 * value) / sum(x % 3) ELSE 0 END, 6) AS value FROM {PIXELS_SQL} p GROUP BY 1, 2, 3 HAVING count(*) = 36")
def weighted_blocks(spark, sf):
    """Weighted averages of whole blocks; blocks cut at the edge are left out."""
    p = _pixels(spark, sf).withColumn("w", F.expr("cast(x % 3 as double)"))
    return images.pixel_blocks(p, 6, "w", whole=True).select("image", "bx", F.col("by").alias("iy"), F.round("value", 6).alias("value"))


@query(f"SELECT a.image, a.x, a.y, round(a.value / b.value, 9) AS value FROM {PIXELS_SQL} a JOIN (SELECT image - 1 AS image, x, y, 2 * value + 1 AS value FROM {PIXELS_SQL} p) b ON a.image = b.image AND a.x = b.x AND a.y = b.y")
def image_ratio(spark, sf):
    """An image divided by the next one, scaled, pixel by pixel."""
    nxt = images.scaled_image(_pixels(spark, sf).withColumn("image", F.col("image") - 1), 2.0, 1.0)
    return images.arithmetic(_pixels(spark, sf), nxt, "/").select("image", "x", "y", F.round("value", 9).alias("value"))


@query(f"SELECT image, max(x) + 1 AS width, max(y) + 1 AS height, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread FROM {PIXELS_SQL} p GROUP BY image")
def image_statistics(spark, sf):
    """Sizes and values of images."""
    s = images.image_statistics(_pixels(spark, sf))
    return s.select("image", "width", "height", "low", "high", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(f"SELECT image, x + 3 AS x, y - 2 AS y, round(value, 4) AS value FROM {PIXELS_SQL} p WHERE x + 3 < 20 AND y - 2 >= 0")
def resampled_image(spark, sf):
    """All images put on the grid of a projection shifted by whole pixels keep their values."""
    src = wcs.Tan((120.0, 30.0), (10.0, 10.0), (-0.01, 0.0, 0.0, 0.01), (20.0, 20.0))
    pixels = _pixels(spark, sf).select("image", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "value")
    out = images.resample(pixels, src, wcs.shifted(src, -3, 2), 2, ["image"])
    return out.where("weight > 0.5").select("image", "x", "y", F.round("value", 4).alias("value"))


# ---- fields, matches, indexes --------------------------------------------------------------------


@query(f"""WITH RECURSIVE f AS {FIELDS}, w AS (
  SELECT DISTINCT field, cast(-1 as bigint) AS k, [] :: STRUCT(id BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM f
  UNION ALL SELECT w.field, s.rank, CASE WHEN len(list_filter(kept, lambda p: (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= {num(15.0**2)})) > 0 THEN kept ELSE list_append(kept, {{'id': s.id, 'x': s.x, 'y': s.y}}) END
    FROM w JOIN f s ON w.field = s.field AND s.rank = w.k + 1)
SELECT u.m.id AS id FROM (SELECT unnest(kept) AS m FROM w JOIN (SELECT field, max(rank) AS k FROM f GROUP BY field) e ON w.field = e.field AND w.k = e.k) u""")
def field_star_dedup(spark, sf):
    """Field stars without those beside a kept brighter one."""
    return match_stats.dedup_field_stars(fields(spark, sf), 15.0).select("id")


@query(f"SELECT field, 'repeated id' AS reason, count(*) AS n FROM (SELECT cast(floor(id / 10.0) as bigint) AS field, id FROM {POINTS} p WHERE id % 7 = 0) s GROUP BY field UNION ALL SELECT cast(floor(id / 10.0) as bigint), 'no position', 2 * count(*) FROM {POINTS} p WHERE id % 21 = 0 GROUP BY 1")
def invalid_fields(spark, sf):
    """What is wrong with lists of field stars."""
    p = points(spark, sf).selectExpr("id", "cast(floor(id / 10.0) as bigint) AS field", "CASE WHEN id % 21 <> 0 THEN x END AS x", "y")
    return match_stats.invalid_fields(p.unionByName(p.where("id % 7 = 0")))


@query("SELECT user_id AS field, event_type AS solution, max(value) AS odds FROM events GROUP BY 1, 2")
def unique_solutions(spark, sf):
    """Solutions found several times, once."""
    m = _read(spark, sf, "events").selectExpr("user_id AS field", "event_type AS solution", "value AS odds")
    return match_stats.unique_solutions(m, ["field", "solution"], "odds")


@query("""SELECT o_orderkey AS image, round(o_totalprice / 1000, 6) AS guess FROM orders WHERE o_orderkey % 3 = 0 AND o_totalprice > 0 UNION ALL SELECT o_orderkey, round(degrees(0.001) * 3600 * 9 / (o_totalprice / 100), 6) FROM orders WHERE o_orderkey % 3 = 1 AND o_totalprice > 0
  UNION ALL SELECT o_orderkey, round(sqrt(abs(o_totalprice / 1e8 * (o_totalprice / 1e8 + 0.001) + 0.0004)) * 3600, 6) FROM orders WHERE o_orderkey % 3 = 2 AND o_totalprice > 0""")
def guess_scale(spark, sf):
    """Scales from headers of three kinds: a scale, optics, a matrix."""
    o = _read(spark, sf, "orders")
    kinds = ["map('pixscale', cast(o_totalprice / 1000 as string))", "map('FOCALLEN', cast(o_totalprice / 100 as string), 'XPIXSZ', '9.0')", "map('CD1_1', cast(o_totalprice / 1e8 as string), 'CD1_2', '0.02', 'CD2_1', '-0.02', 'CD2_2', cast(o_totalprice / 1e8 + 0.001D as string))"]
    h = o.selectExpr("o_orderkey AS image", f"explode(CASE o_orderkey % 3 WHEN 0 THEN {kinds[0]} WHEN 1 THEN {kinds[1]} ELSE {kinds[2]} END) AS (name, value)")
    return match_stats.guess_scale(h).select("image", F.round("guess", 6).alias("guess"))


_LOW, _HIGH = match_stats.pixel_range("p_size", "(p_size + 1)", (2.0, 4.0))


@query("SELECT p_partkey, round(p_size * 60.0 / 4.0, 9) AS low, round((p_size + 1) * 60.0 / 2.0, 9) AS high FROM part")
def pixel_range(spark, sf):
    """Pixels that features can span."""
    return _read(spark, sf, "part").select("p_partkey", F.round(F.expr(_LOW), 9).alias("low"), F.round(F.expr(_HIGH), 9).alias("high"))


@query(f"""WITH s AS {_STARS}, f AS {_FEATURES}, u AS (SELECT star, count(*) AS uses FROM (SELECT unnest([a, b, c, d]) AS star FROM f) e GROUP BY star), c AS (SELECT cell, count(*) AS n FROM s GROUP BY cell)
  SELECT (SELECT cast(sum(n) as bigint) FROM c) AS n_stars, (SELECT count(*) FROM c) AS n_cells, (SELECT max(n) FROM c) AS most_in_cell, (SELECT count(*) FROM f) AS n_quads,
    (SELECT count(*) FROM u) AS n_used, (SELECT max(uses) FROM u) AS most_uses, (SELECT round(avg(uses), 9) FROM u) AS mean_uses""")
def index_summary(spark, sf):
    """The numbers of an index: stars, cells, features, uses."""
    i = _fixed_index(spark, sf)
    return match_stats.index_summary(i.stars, i.quads).withColumn("mean_uses", F.round("mean_uses", 9))


@query(f"""SELECT cast(floor(lo / 10) as bigint) AS bright, cast(floor(hi / 10) as bigint) AS faint, count(*) AS n FROM (
  SELECT quad_id, min(mag) AS lo, max(mag) AS hi FROM (SELECT quad_id, unnest([a, b, c, d]) AS star FROM {_FEATURES} f) m JOIN {_STARS} s ON m.star = s.id GROUP BY quad_id) e GROUP BY 1, 2""")
def feature_magnitudes(spark, sf):
    """Brightest and faintest member of every feature, in a histogram of both."""
    i = _fixed_index(spark, sf)
    m = match_stats.feature_magnitudes(i.quads, i.stars)
    return m.groupBy(F.floor(F.col("brightest") / 10).alias("bright"), F.floor(F.col("faintest") / 10).alias("faint")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT a.id AS l_id, b.id AS r_id, round(abs(a.x - b.x) + abs(a.y - b.y), 9) AS dist FROM {POINTS} a JOIN {POINTS} b ON a.id < b.id AND abs(a.x - b.x) + abs(a.y - b.y) <= 0.6")
def city_block_join(spark, sf):
    """Pairs under another distance: the sum of the differences."""
    p = points(spark, sf)
    d = F.abs(F.col("l0") - F.col("r0")) + F.abs(F.col("l1") - F.col("r1"))
    return spatial.join_by(p, p, d * d, 0.6, ("x", "y")).where("l_id < r_id").select("l_id", "r_id", F.round(F.sqrt("dist2"), 9).alias("dist"))


@query(f"SELECT id FROM {CUSTOMERS} a JOIN (SELECT cos(radians(40.0)) * cos(radians(150.0)) AS x, cos(radians(40.0)) * sin(radians(150.0)) AS y, sin(radians(40.0)) AS z) b ON {sky.dist2('a', 'b')} <= {_chord2(25.0)} AND mag > 3000")
def cone_search_accepted(spark, sf):
    """Stars of a cone that a condition accepts."""
    return spatial.cone_search(customers(spark, sf), 150.0, 40.0, 25.0, accept=F.col("mag") > 3000).select("id")


def _hooked() -> str:
    """The SQL of quad_codes' features before their normal form, with the hooks' conditions."""
    from skyweft.catalog_queries import QUADS_SQL

    return f"SELECT field, a, b, c, d FROM {QUADS_SQL} q WHERE newest < 8 AND a % 2 = 0 AND cx < 0.6 AND dx < 0.6"


@query(_hooked())
def quads_with_hooks(spark, sf):
    """Features under conditions of one's own on pairs, inner stars and whole features."""
    q = quads.enumerate_quads(fields(spark, sf), "field", "id", "x", "y", "rank", 40.0, 130.0, check_pair="a_id % 2 = 0", check_inner="cx < 0.6", check_quad="newest < 8")
    return q.select("field", "a", "b", "c", "d")


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY cast(floor(id / 10.0) as bigint) ORDER BY flux DESC, id) AS k FROM {POINTS} p) s WHERE k <= 4")
def first_field_stars(spark, sf):
    """The first stars of each field."""
    return table.head_rows(fields(spark, sf), 4, [F.col("rank")], ["field"]).select("id")


# ---- SQL of queries that are registered elsewhere ------------------------------------------------

_E = "(SELECT id, 1.0 + id % 5 AS a, {f11} * 0.9 AS e, {f23} * pi() AS i, {f37} * 2 * pi() AS node, {f41} * 2 * pi() AS peri, {f53} * 2 * pi() AS mean FROM {src} o0)"


def _orbits() -> str:
    e = _E.format(f11=_frac("id", 0.11), f23=_frac("id", 0.23), f37=_frac("id", 0.37), f41=_frac("id", 0.41), f53=_frac("id", 0.53), src=CUSTOMERS)
    return f"""WITH RECURSIVE el AS (SELECT * FROM {e} q), step AS (
  SELECT id, e, mean, mean + e * sin(mean) AS x, 0 AS k FROM el
  UNION ALL SELECT id, e, mean, greatest(mean - e, least(mean + e, x - (x - e * sin(x) - mean) / (1 - e * cos(x)))) AS x, k + 1 AS k FROM step WHERE k < 40
), plane AS (SELECT el.*, el.a * (cos(x) - el.e) AS p, el.a * sqrt(1 - el.e * el.e) * sin(x) AS q FROM el JOIN step ON el.id = step.id AND k = 40)
SELECT id, round(p * (cos(node) * cos(peri) - sin(node) * sin(peri) * cos(i)) - q * (cos(node) * sin(peri) + sin(node) * cos(peri) * cos(i)), 6) AS px,
  round(p * (sin(node) * cos(peri) + cos(node) * sin(peri) * cos(i)) - q * (sin(node) * sin(peri) - cos(node) * cos(peri) * cos(i)), 6) AS py,
  round(p * sin(peri) * sin(i) + q * cos(peri) * sin(i), 6) AS pz FROM plane"""


ORACLE_SQL["orbit_positions"] = _orbits()


@query(f"SELECT star, string_agg(cast(quad_id as varchar), ',' ORDER BY quad_id) AS quads FROM (SELECT quad_id, unnest([a, b, c, d]) AS star FROM {_FEATURES} f) m GROUP BY star")
def features_of_stars(spark, sf):
    """The features that each star takes part in."""
    got = quads.star_index(_fixed_index(spark, sf).quads)
    return got.select("star", F.array_join(F.transform("quads", lambda q: q.cast("string")), ",").alias("quads"))


@query(f"SELECT DISTINCT cell FROM {CELL4} c")
def occupied_cells(spark, sf):
    """Cells of the sky that hold a star."""
    return saved_index.occupied_cells(customers(spark, sf), 4)
