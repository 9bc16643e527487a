"""Registry of the catalogue queries and their SQL.

The test tables hold no sky data, so stars, fields, jobs and tags are derived from them by fixed
arithmetic, in the same text for both engines. Each SQL text states a query plainly (cross joins,
ranks); the query itself goes through the operators.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweft.functions import healpix, sky, wcs
from skyweft.functions.sky import num
from skyweft.operators import catalogs, images, quads, spatial, table, uniformize, web
from skyweft.plans import build_index, solve
from skyweft.session import scratch_dir, shuffle_partitions
from skyweft.streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _frac(e: str, k: float) -> str:
    return f"(({e}) * {num(k)} - floor(({e}) * {num(k)}))"


def stars_sql(source: str, key: str, mag: str, shift: int = 0) -> str:
    k = f"({key} + {shift})"
    return f"""(SELECT id, ra, degrees(asin(z)) AS dec, sqrt(1 - z * z) * cos(radians(ra)) AS x, sqrt(1 - z * z) * sin(radians(ra)) AS y, z, mag
      FROM (SELECT {key} AS id, 360 * {_frac(k, 0.5698402909980532)} AS ra, 2 * {_frac(k, 0.7548776662466927)} - 1 AS z, {mag} AS mag FROM {source}) s0)"""


def points_sql(source: str) -> str:
    """2-D points of the parts, scattered over a square of side 100."""
    return f"(SELECT p_partkey AS id, 100 * {_frac('abs(sin(p_partkey * 12.9898))', 4375.85453)} AS x, 100 * {_frac('abs(sin(p_partkey * 78.233))', 4375.85453)} AS y, p_retailprice AS flux FROM {source})"


def field_sql(source: str) -> str:
    """Fields of ten stars each, with 0-based brightness rank."""
    return f"""(SELECT id, x, y, flux, cast(floor(id / 10.0) as bigint) AS field,
      row_number() OVER (PARTITION BY cast(floor(id / 10.0) as bigint) ORDER BY flux DESC, id) - 1 AS rank FROM {points_sql(source)} p0)"""


CUSTOMERS, SUPPLIERS = stars_sql("customer", "c_custkey", "c_acctbal"), stars_sql("supplier", "s_suppkey", "s_acctbal", 7919)
POINTS, FIELDS = points_sql("part"), field_sql("part")


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _of(spark, sf, name: str, text: str) -> DataFrame:
    """A derived table: the SQL text above over one Parquet table."""
    return spark.sql(f"SELECT * FROM {text.replace(f'FROM {name})', 'FROM {src})')}", src=_read(spark, sf, name))


def customers(spark, sf):
    return _of(spark, sf, "customer", CUSTOMERS)


def suppliers(spark, sf):
    return _of(spark, sf, "supplier", SUPPLIERS)


def points(spark, sf):
    return _of(spark, sf, "part", POINTS)


def fields(spark, sf):
    return _of(spark, sf, "part", FIELDS)


def _chord2(deg: float) -> str:
    return num(sky.chord2_of_deg(deg))


D3 = sky.dist2("a", "b")
D2 = sky.dist2("a", "b", ("x", "y"))

# ---- spatial joins -------------------------------------------------------------------------------


@query(f"SELECT a.id AS l_id, b.id AS r_id, round({sky.deg_of_chord2(D3)}, 6) AS dist_deg FROM {CUSTOMERS} a JOIN {CUSTOMERS} b ON a.id < b.id WHERE {D3} <= {_chord2(12.0)}")
def sky_radius_join(spark, sf):
    """Pairs of customers' stars within twelve degrees."""
    s = customers(spark, sf)
    return spatial.sky_radius_join(s, s, 12.0, block=2).where("l_id < r_id").select("l_id", "r_id", F.round("dist_deg", 6).alias("dist_deg"))


@query(f"SELECT a.id AS l_id, b.id AS r_id, round({sky.deg_of_chord2(D3)}, 6) AS dist_deg FROM {CUSTOMERS} a JOIN {SUPPLIERS} b ON {D3} BETWEEN {_chord2(1.0)} AND {_chord2(3.0)}")
def sky_ring_join(spark, sf):
    """Pairs of two catalogues at one to three degrees."""
    return spatial.sky_radius_join(customers(spark, sf), suppliers(spark, sf), 3.0, min_deg=1.0).select("l_id", "r_id", F.round("dist_deg", 6).alias("dist_deg"))


@query(f"SELECT a.id AS l_id, count(b.id) AS n FROM {CUSTOMERS} a LEFT JOIN {SUPPLIERS} b ON {D3} <= {_chord2(5.0)} GROUP BY a.id")
def sky_counts(spark, sf):
    """Suppliers' stars within five degrees of each customer's, zero included."""
    return spatial.count_in_radius(customers(spark, sf), suppliers(spark, sf), math.sqrt(sky.chord2_of_deg(5.0)), ("x", "y", "z"))


@query(f"""SELECT l_id, r_id, round(d2, 9) AS dist2 FROM (SELECT a.id AS l_id, b.id AS r_id, {D3} AS d2,
  row_number() OVER (PARTITION BY a.id ORDER BY {D3}, b.id) AS k FROM {CUSTOMERS} a CROSS JOIN {SUPPLIERS} b) s WHERE k = 1""")
def sky_nearest(spark, sf):
    """The nearest supplier's star of each customer's, whatever its distance."""
    other = suppliers(spark, sf)
    reach = 3.5 / math.sqrt(max(1, other.count()))  # about three stars in reach
    return spatial.nearest(customers(spark, sf), other, ("x", "y", "z"), reach).select("l_id", "r_id", F.round("dist2", 9).alias("dist2"))


@query(f"""SELECT l_id, r_id, round(d2, 9) AS dist2, n FROM (SELECT a.id AS l_id, b.id AS r_id, {D3} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D3}, b.id) AS k,
  count(*) OVER (PARTITION BY a.id) AS n FROM {CUSTOMERS} a JOIN {SUPPLIERS} b ON {D3} <= {_chord2(6.0)}) s WHERE k = 1""")
def sky_nearest_and_count(spark, sf):
    """Nearest within six degrees, and how many lie within."""
    out = spatial.nearest_in_radius(customers(spark, sf), suppliers(spark, sf), math.sqrt(sky.chord2_of_deg(6.0)), ("x", "y", "z"))
    return out.select("l_id", "r_id", F.round("dist2", 9).alias("dist2"), F.col("n").cast("long").alias("n"))


@query(f"SELECT a.id AS l_id, string_agg(cast(b.id AS VARCHAR), ',' ORDER BY b.id) AS matches FROM {SUPPLIERS} a LEFT JOIN {CUSTOMERS} b ON {D3} <= {_chord2(3.0)} GROUP BY a.id")
def sky_match_lists(spark, sf):
    """Customers' stars within three degrees of each supplier's, listed as a text; null where there are none."""
    out = spatial.match_lists(suppliers(spark, sf), customers(spark, sf), math.sqrt(sky.chord2_of_deg(3.0)), ("x", "y", "z"))
    return out.select("l_id", F.array_join("matches", ",").alias("matches"))


@query(f"SELECT a.id AS l_id, b.id AS r_id, round({D2}, 9) AS dist2 FROM {POINTS} a JOIN {POINTS} b ON a.id <> b.id AND {D2} <= 0.64")
def xy_match(spark, sf):
    """Pairs of 2-D points within 0.8, both ways."""
    p = points(spark, sf)
    return spatial.radius_join(p, p, 0.8, ("x", "y"), not_self=True).select("l_id", "r_id", F.round("dist2", 9).alias("dist2"))


@query("""SELECT a.vec_id AS l_id, b.vec_id AS r_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))), 6) AS dist2
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (cast(p[1] as double) - cast(p[2] as double)) * (cast(p[1] as double) - cast(p[2] as double)))) <= 1.21""")
def nd_radius_join(spark, sf):
    """Pairs of 64-dimensional vectors within 1.1."""
    e = _read(spark, sf, "embeddings")
    near = spatial.array_radius_join(e, e, 1.1, "embedding", "vec_id", "vec_id", ordered=True)
    both = F.explode(F.array(F.struct(F.col("l_id").alias("l"), F.col("r_id").alias("r")), F.struct(F.col("r_id").alias("l"), F.col("l_id").alias("r"))))
    return near.select(both.alias("p"), F.round("dist2", 6).alias("dist2")).select(F.col("p.l").alias("l_id"), F.col("p.r").alias("r_id"), "dist2")


@query(f"""WITH RECURSIVE s AS (SELECT * FROM {CUSTOMERS} s1), e AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.id <> b.id AND {D3} <= {_chord2(2.2)}),
  reach AS (SELECT id, id AS other FROM s UNION SELECT reach.id, e.v AS other FROM reach JOIN e ON reach.other = e.u)
  SELECT id, min(other) AS group_id FROM reach GROUP BY id""")
def fof_groups(spark, sf):
    """Friends of friends within 2.2 degrees."""
    return spatial.friends_of_friends(customers(spark, sf), math.sqrt(sky.chord2_of_deg(2.2)), ("x", "y", "z"))


@query(f"SELECT a.id, round({sky.deg_of_chord2(D3)}, 6) AS dist_deg FROM {CUSTOMERS} a JOIN (SELECT cos(radians(40.0)) * cos(radians(150.0)) AS x, cos(radians(40.0)) * sin(radians(150.0)) AS y, sin(radians(40.0)) AS z) b ON {D3} <= {_chord2(12.0)}")
def cone_search(spark, sf):
    """Stars within twelve degrees of RA 150, Dec 40, pruned by cells."""
    s = healpix.with_cell(customers(spark, sf), 8)
    return spatial.cone_search(s, 150.0, 40.0, 12.0, "cell", 8).select("id", F.round("dist_deg", 6).alias("dist_deg"))


_FROM_HERE = "((x - 40e0) * (x - 40e0) + (y - 60e0) * (y - 60e0))"


@query(f"SELECT id, round({_FROM_HERE}, 6) AS dist2 FROM {POINTS} a WHERE {_FROM_HERE} <= 225")
def range_search(spark, sf):
    """Points within 15 of one place."""
    return spatial.within(points(spark, sf), (40.0, 60.0), 15.0, ("x", "y")).select("id", F.round("dist2", 6).alias("dist2"))


@query(f"SELECT id, round(d, 6) AS dist2 FROM (SELECT id, {_FROM_HERE} AS d, row_number() OVER (ORDER BY {_FROM_HERE}, id) AS k FROM {POINTS} a) s WHERE k <= 25")
def nearest_points(spark, sf):
    """The 25 points nearest to one place, by boxes that grow."""
    return spatial.nearest_to(points(spark, sf), (40.0, 60.0), ("x", "y"), n=25, first_radius=0.5).select("id", F.round("dist2", 6).alias("dist2"))


@query(f"SELECT id, cell AS tile FROM {healpix.cell_sql(CUSTOMERS, 2, 'id')} s WHERE cell = 21")
def owned_stars(spark, sf):
    """The stars of one tile, its own ones out of those within three degrees of it."""
    return build_index.owned_by_tile(customers(spark, sf), 21, 2, 3.0).where("own").select("id", F.lit(21).cast("long").alias("tile"))


@query(f"SELECT id AS number, round({sky.deg_of_chord2(D3)}, 6) AS dist_deg FROM {CUSTOMERS} a JOIN (SELECT cos(radians(-20.0)) * cos(radians(75.0)) AS x, cos(radians(-20.0)) * sin(radians(75.0)) AS y, sin(radians(-20.0)) AS z) b ON {D3} <= {_chord2(15.0)}")
def numbered_cone(spark, sf):
    """Numbers of stars in a cone, of a catalogue whose numbers are places in its file."""
    s = customers(spark, sf).withColumn("place", F.col("id") - 1)
    return catalogs.numbers_within(s, "place", 75.0, -20.0, 15.0).select("number", F.round("dist_deg", 6).alias("dist_deg"))


@query(f"SELECT id, round(x, 9) AS x, round(y, 9) AS y FROM {POINTS} a WHERE x BETWEEN 10 AND 30 AND y BETWEEN 50 AND 90")
def box_search(spark, sf):
    """Points in a box."""
    return spatial.in_box(points(spark, sf), {"x": (10, 30), "y": (50, 90)}).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


# ---- sky cells, thinning, rank orders ------------------------------------------------------------


CELL4, CELL8 = (healpix.cell_sql(CUSTOMERS, n, "id, mag, x, y, z") for n in (4, 8))


@query(f"SELECT cell, count(*) AS n, min(mag) AS brightest FROM {CELL4} s GROUP BY cell")
def cell_counts(spark, sf):
    """Stars per equal-area cell."""
    return healpix.with_cell(customers(spark, sf), 4).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("mag").alias("brightest"))


@query(f"SELECT id, cell, {healpix.to_nested('cell', 8)} AS nested, {healpix.to_ring('cell', 8)} AS ring FROM {CELL8} c")
def cell_schemes(spark, sf):
    """A star's cell in three numberings."""
    s = healpix.with_cell(customers(spark, sf), 8)
    return s.select("id", "cell", F.expr(healpix.to_nested("cell", 8)).alias("nested"), F.expr(healpix.to_ring("cell", 8)).alias("ring"))


@query(f"""SELECT id, cell, cast(k - 1 as bigint) AS sweep FROM (SELECT id, cell, row_number() OVER (PARTITION BY cell ORDER BY mag, id) AS k
  FROM {CELL4} c WHERE mag > 0) r WHERE k <= 3""")
def uniformize_top(spark, sf):
    """The three brightest stars of each cell above a cut."""
    s = healpix.with_cell(customers(spark, sf), 4)
    out = uniformize.uniformize_top(s, "cell", [F.col("mag"), F.col("id")], 3, F.col("mag") > 0)
    return out.select("id", "cell", F.col("sweep").cast("long").alias("sweep"))


@query()
def uniformize_dedup(spark, sf):
    """Up to four stars per cell, none nearer than three degrees to one kept before."""
    s = healpix.with_cell(customers(spark, sf), 4)
    return uniformize.uniformize_dedup(s, "id", "mag", "cell", 4, math.sqrt(sky.chord2_of_deg(3.0)))


@query("""SELECT event_id, cast(row_number() OVER (PARTITION BY user_id ORDER BY k) - 1 as bigint) AS place FROM (SELECT event_id, user_id, least(2 * a, 2 * b + 1) AS k FROM
  (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS a,
  row_number() OVER (PARTITION BY user_id ORDER BY value + event_id % 7 DESC, event_id) - 1 AS b FROM events) r) s""")
def resort_interleave(spark, sf):
    """Each user's events by two flux orders in turn."""
    e = _read(spark, sf, "events").select("event_id", "user_id", "value")
    out = uniformize.interleave(e, ["user_id"], [F.desc("value"), F.col("event_id")], [F.desc(F.expr("value + event_id % 7")), F.col("event_id")])
    return out.select("event_id", F.col("place").cast("long").alias("place"))


@query(f"""SELECT id, cast(row_number() OVER (PARTITION BY half ORDER BY r, rank, id) - 1 as bigint) AS place FROM (SELECT id, half, rank,
  row_number() OVER (PARTITION BY half, bin ORDER BY rank, id) AS r FROM (SELECT id, rank, id % 2 AS half, cast(floor(x / 25) as bigint) * 4 + cast(floor(y / 25) as bigint) AS bin FROM {FIELDS} f) b) s""")
def uniform_order(spark, sf):
    """Field stars round robin over bins of the field."""
    f = fields(spark, sf).selectExpr("id", "rank", "id % 2 AS half", "cast(floor(x / 25) as bigint) * 4 + cast(floor(y / 25) as bigint) AS bin")
    return uniformize.round_robin(f, ["half"], "bin", [F.col("rank"), F.col("id")]).select("id", F.col("place").cast("long").alias("place"))


@query()
def margin_tiles(spark, sf):
    """Every star in each of the twelve tiles that hold it or lie within ten degrees."""
    return build_index.tiles_with_margin(customers(spark, sf), 1, 10.0).select("tile", "id", "own")


# ---- table tools ---------------------------------------------------------------------------------


@query("SELECT greatest(0, least(9, cast(floor((l_quantity - 5.0) / 4.0) as bigint))) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def hist1d_clamped(spark, sf):
    """Ten bins of quantity, outliers in the end bins."""
    return table.histogram(_read(spark, sf, "lineitem"), "l_quantity", 5.0, 4.0, 10)


@query("""SELECT bx, iy, count(*) AS n FROM (SELECT greatest(0, least(9, cast(floor(l_quantity / 5.0) as bigint))) AS bx, cast(floor((l_extendedprice - 1000.0) / 9000.0) as bigint) AS iy FROM lineitem) s
  WHERE iy >= 0 AND iy < 8 GROUP BY bx, iy""")
def hist2d_discard(spark, sf):
    """Quantity by price, the second axis discards outliers."""
    return table.histogram2d(_read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 5.0, 10), (1000.0, 9000.0, 8), ("clamp", "discard")).withColumnRenamed("by", "iy")


@query("SELECT round(sum(n * bin * 4.0) / sum(n) + 5.0, 9) AS mean FROM (SELECT greatest(0, least(9, cast(floor((l_quantity - 5.0) / 4.0) as bigint))) AS bin, count(*) AS n FROM lineitem GROUP BY 1) h")
def hist_mean(spark, sf):
    """Mean of a histogram by left bin edges."""
    return table.histogram_mean(table.histogram(_read(spark, sf, "lineitem"), "l_quantity", 5.0, 4.0, 10), 5.0, 4.0).select(F.round("mean", 9).alias("mean"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) s WHERE k <= 25")
def head_rows(spark, sf):
    """The first 25 rows of each extension of a sorted table."""
    return table.head_rows(_read(spark, sf, "orders"), 25, [F.desc("o_totalprice"), F.col("o_orderkey")], ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def sort_table(spark, sf):
    """Orders by falling price."""
    return table.sort_table(_read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "-o_totalprice", "o_orderkey")


@query("SELECT p.position, c.c_custkey, c.c_name FROM (SELECT unnest([0, 1, 2, 3]) AS position, unnest([5, 99, 5, 42]) AS pick) p JOIN customer c ON c.c_custkey = p.pick")
def gather_rows(spark, sf):
    """Rows by a list that repeats one."""
    return table.gather_list(_read(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", [5, 99, 5, 42]).select("position", "c_custkey", "c_name")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey >= 10 AND c_custkey < 100 AND (c_custkey - 10) % 7 = 0")
def slice_rows(spark, sf):
    """Rows 10 to 100 in steps of 7."""
    return table.slice_rows(_read(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 10, 100, 7)


@query("SELECT c_custkey, c_name, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer")
def masked_assign(spark, sf):
    """Negative balances set to zero, three columns kept, one renamed."""
    c = table.assign_where(_read(spark, sf, "customer"), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)})
    return table.subtable(c, ["c_custkey", "c_name", "c_acctbal"], {"c_acctbal": "balance"})


@query("SELECT a.k, a.v, b.v AS v_2, b.w FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a JOIN (SELECT s_suppkey AS k, s_acctbal AS v, s_nationkey AS w FROM supplier) b ON a.k = b.k")
def column_zip(spark, sf):
    """Columns of two tables side by side by row."""
    a = _read(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    return table.column_zip(a, _read(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v", "s_nationkey AS w"), "k")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_strict(spark, sf):
    """Rows of two tables of equal columns."""
    return table.merge_tables([_read(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v"), _read(spark, sf, "supplier").selectExpr("s_acctbal AS v", "s_suppkey AS k")])


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_minimal(spark, sf):
    """Rows of two tables over the columns both have."""
    return table.merge_tables([_read(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v", "c_name AS n"), _read(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v")], "minimal")


@query("SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS seg, 0 AS w FROM customer UNION ALL SELECT s_suppkey, s_acctbal, '', s_nationkey FROM supplier")
def merge_fillzero(spark, sf):
    """Rows of two tables over all columns, zero where a table lacks one."""
    return table.merge_tables([_read(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v", "c_mktsegment AS seg"), _read(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_acctbal AS v", "s_nationkey AS w")], "fillzero")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(abs(l_extendedprice - 20000.0), 0.6827), 6) AS spread FROM lineitem GROUP BY l_returnflag""")
def order_statistics(spark, sf):
    """Exact median and spread by group."""
    kinds = {"median": (0.5, "l_extendedprice"), "spread": (0.6827, "abs(l_extendedprice - 20000.0)")}
    long = _read(spark, sf, "lineitem").selectExpr("l_returnflag", "explode(array(" + ", ".join(f"struct('{k}' AS kind, {num(s)} AS share, cast({e} AS double) AS v)" for k, (s, e) in kinds.items()) + ")) AS k")
    q = table.group_quantiles(long.select("l_returnflag", "k.kind", "k.share", "k.v"), ["l_returnflag", "kind"], "v", "share")
    return q.groupBy("l_returnflag").agg(*[F.round(F.max(F.when(F.col("kind") == k, F.col("quantile"))), 6).alias(k) for k in kinds])


@query("SELECT cast(floor(epoch(ts) / 600) * 600 as bigint) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    """Ten-minute windows of events."""
    w = jobs.windowed_counts(_read(spark, sf, "events"), "ts", "event_type", "value")
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


# ---- features, projections, matches --------------------------------------------------------------

_PAIR = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)"
_C, _D = quads.pixel_code("a.x", "a.y", "b.x", "b.y", "c.x", "c.y"), quads.pixel_code("a.x", "a.y", "b.x", "b.y", "d.x", "d.y")
QUADS_SQL = f"""(SELECT a.field, a.id AS a, b.id AS b, c.id AS c, d.id AS d, {_C[0]} AS cx, {_C[1]} AS cy, {_D[0]} AS dx, {_D[1]} AS dy, greatest(b.rank, d.rank) AS newest
  FROM {FIELDS} a JOIN {FIELDS} b ON a.field = b.field AND a.rank < b.rank JOIN {FIELDS} c ON a.field = c.field AND c.id <> a.id AND c.id <> b.id
  JOIN {FIELDS} d ON a.field = d.field AND d.id <> a.id AND d.id <> b.id AND c.rank < d.rank
  WHERE {_PAIR} BETWEEN {num(40.0**2)} AND {num(130.0**2)} AND {quads.in_circle(*_C)} AND {quads.in_circle(*_D)})"""
_FLIP = "(CASE WHEN (cx + dx) / 2 > 0.5 THEN {} ELSE {} END)"
NORMAL_SQL = f"""(SELECT field, a, b, CASE WHEN s THEN d ELSE c END AS c, CASE WHEN s THEN c ELSE d END AS d, CASE WHEN s THEN dx ELSE cx END AS cx, CASE WHEN s THEN dy ELSE cy END AS cy,
  CASE WHEN s THEN cx ELSE dx END AS dx, CASE WHEN s THEN cy ELSE dy END AS dy FROM (SELECT *, cx > dx OR (cx = dx AND c > d) AS s FROM (SELECT field, {_FLIP.format('b', 'a')} AS a, {_FLIP.format('a', 'b')} AS b, c, d,
  {', '.join(f"{_FLIP.format('1 - ' + v, v)} AS {v}" for v in ('cx', 'cy', 'dx', 'dy'))} FROM {QUADS_SQL} q) f) g)"""


def _quads(spark, sf):
    return quads.normal_form(quads.enumerate_quads(fields(spark, sf), "field", "id", "x", "y", "rank", 40.0, 130.0))


@query(f"SELECT field, a, b, c, d, round(cx, 9) AS cx, round(cy, 9) AS cy, round(dx, 9) AS dx, round(dy, 9) AS dy FROM {NORMAL_SQL} n")
def quad_codes(spark, sf):
    """Four-star features of all fields, in normal form."""
    return _quads(spark, sf).select("field", "a", "b", "c", "d", *[F.round(v, 9).alias(v) for v in ("cx", "cy", "dx", "dy")])


@query(f"SELECT uses, count(*) AS n_stars FROM (SELECT star, count(*) AS uses FROM (SELECT unnest([a, b, c, d]) AS star FROM {NORMAL_SQL} n) e GROUP BY star) u GROUP BY uses")
def quad_uses(spark, sf):
    """How many stars take part in how many features."""
    return quads.use_counts(_quads(spark, sf))


_CODE4 = sky.dist2("l", "r", ("cx", "cy", "dx", "dy"))


@query(f"SELECT l.a AS la, l.b AS lb, l.c AS lc, l.d AS ld, r.a AS ra, r.b AS rb, r.c AS rc, r.d AS rd, round({_CODE4}, 9) AS dist2 FROM {NORMAL_SQL} l JOIN {NORMAL_SQL} r ON l.field % 2 = 0 AND r.field % 2 = 1 AND {_CODE4} <= {num(0.03**2)}")
def code_match(spark, sf):
    """Features of even fields with a code near one of an odd field."""
    q = _quads(spark, sf).withColumn("quad_id", F.array("a", "b", "c", "d"))
    m = quads.code_join(q.where("field % 2 = 0"), q.where("field % 2 = 1"), 0.03)
    pick = lambda s, p: [F.col(f"{s}_id")[i].alias(f"{p}{n}") for i, n in enumerate("abcd")]
    return m.select(*pick("l", "l"), *pick("r", "r"), F.round("dist2", 9).alias("dist2"))


TAN = wcs.Tan((120.0, 30.0), (500.0, 400.0), (-0.02, 0.005, 0.005, 0.02), (1000.0, 800.0))
_PX, _PY = wcs.sky_to_pixel(TAN, "x", "y", "z")


@query(f"SELECT id, round(px, 6) AS px, round(py, 6) AS py FROM (SELECT id, {_PX} AS px, {_PY} AS py FROM {CUSTOMERS} s) p WHERE {wcs.in_image(TAN, 'px', 'py')}")
def in_field(spark, sf):
    """Stars inside an image, with their pixels."""
    s = customers(spark, sf).select("id", F.expr(_PX).alias("px"), F.expr(_PY).alias("py"))
    return s.where(wcs.in_image(TAN, "px", "py")).select("id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


_RA, _DEC = wcs.pixel_to_sky(TAN, "px", "py")


@query(f"SELECT id, round({_RA}, 8) AS ra, round({_DEC}, 8) AS dec FROM (SELECT id, x * 10 AS px, y * 8 AS py FROM {POINTS} p) q")
def pixel_to_sky(spark, sf):
    """Sky positions of pixels."""
    return points(spark, sf).selectExpr("id", "x * 10 AS px", "y * 8 AS py").select("id", F.round(F.expr(_RA), 8).alias("ra"), F.round(F.expr(_DEC), 8).alias("dec"))


_L, _B = sky.galactic("ra", "dec")
_EL, _EB = sky.ecliptic("ra", "dec")
_HX, _HY = sky.hammer_aitoff("ra", "dec")


@query(f"SELECT id, round({_L}, 7) AS l, round({_B}, 7) AS b, round({_EL}, 7) AS lon, round({_EB}, 7) AS lat, round({_HX}, 7) AS hx, round({_HY}, 7) AS hy, round({sky.flux_of_mag('mag / 1000')}, 7) AS flux FROM {CUSTOMERS} s")
def sky_frames(spark, sf):
    """Galactic and ecliptic coordinates, an equal-area projection and fluxes."""
    cols = {"l": _L, "b": _B, "lon": _EL, "lat": _EB, "hx": _HX, "hy": _HY, "flux": sky.flux_of_mag("mag / 1000")}
    return customers(spark, sf).select("id", *[F.round(F.expr(e), 7).alias(n) for n, e in cols.items()])


def _sexagesimal(string: str) -> str:
    return f"{sky.hms('ra')} AS hms, {sky.dms('dec')} AS dms".replace("string", string)


@query(f"SELECT id, {_sexagesimal('varchar')} FROM {CUSTOMERS} s")
def sexagesimal(spark, sf):
    """Positions as texts of hours and degrees."""
    return customers(spark, sf).selectExpr("id", sky.hms("ra") + " AS hms", sky.dms("dec") + " AS dms")


@query("SELECT event_id, round(epoch_us(ts) / 86400000000.0 + 40587.0, 9) AS mjd FROM events")
def event_mjd(spark, sf):
    """Modified Julian dates of events."""
    return _read(spark, sf, "events").select("event_id", F.round(F.expr(sky.mjd_of_micros("unix_micros(cast(ts as timestamp))")), 9).alias("mjd"))


MATCHES_SQL = "(SELECT event_id, user_id AS field, value AS odds, event_id % 20 AS n_index FROM events)"


def _matches(spark, sf):
    return _read(spark, sf, "events").selectExpr("event_id", "user_id AS field", "value AS odds", "event_id % 20 AS n_index")


@query(f"SELECT event_id, field, odds, n_index FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY odds DESC, event_id DESC, n_index DESC) AS k FROM {MATCHES_SQL} m) s WHERE k = 1")
def best_by_field(spark, sf):
    """The likeliest match of each field."""
    return solve.best_match(_matches(spark, sf), "field", "odds")


@query(f"SELECT event_id, field, odds, n_index FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY event_id) AS k FROM {MATCHES_SQL} m WHERE odds >= 50 AND n_index >= 5) s WHERE k = 1")
def first_agreeing(spark, sf):
    """The first match of each field that passes both limits."""
    return solve.agreeing(_matches(spark, sf), "field", "odds", "n_index", "event_id", 50.0, 5, "first")


@query(f"SELECT * FROM {MATCHES_SQL} m WHERE field NOT IN (SELECT field FROM {MATCHES_SQL} g WHERE odds >= 50 AND n_index >= 15)")
def leftover_matches(spark, sf):
    """Matches of the fields that nothing passes for."""
    return solve.leftovers(_matches(spark, sf), "field", "odds", "n_index", 50.0, 15)


@query("""SELECT coalesce(a.field, b.field) AS field, a.odds AS odds_a, b.odds AS odds_b FROM (SELECT user_id AS field, max(value) AS odds FROM events WHERE event_id % 2 = 0 GROUP BY 1) a
  FULL JOIN (SELECT user_id AS field, max(value) AS odds FROM events WHERE event_id % 2 = 1 GROUP BY 1) b ON a.field = b.field""")
def compare_runs(spark, sf):
    """Results of two runs field by field."""
    half = lambda k, n: _matches(spark, sf).where(f"event_id % 2 = {k}").groupBy("field").agg(F.max("odds").alias(n))
    return half(0, "odds_a").join(half(1, "odds_b"), "field", "full")


@query()
def planted_field(spark, sf):
    """A field cut from the stars, turned, scaled and shaken, is found again in an index of them."""
    s = customers(spark, sf)
    index = build_index.build_index(s.select("id", "ra", "dec", "mag"), "id", "ra", "dec", "mag", (180.0, 1200.0), per_cell=6, quads_per_cell=12, max_uses=20, nside=4)
    w = wcs.Tan((120.0, 30.0), (500.0, 400.0), (-0.03, 0.01, 0.01, 0.03), (1000.0, 800.0))
    px, py = wcs.sky_to_pixel(w, "x", "y", "z")
    seen = index.stars.select("id", "mag", F.expr(px).alias("x"), F.expr(py).alias("y")).where(wcs.in_image(w, "x", "y"))
    shaken = seen.selectExpr("cast(1 as bigint) AS field", "id", "mag", f"x + {_frac('id', 0.7320508)} - 0.5 AS x", f"y + {_frac('id', 0.2360679)} - 0.5 AS y")
    field = table.ranked(shaken, [F.col("mag"), F.col("id")], ["field"])
    found = solve.solve(field, index.stars, index.quads, 60.0, 900.0, (90.0, 140.0), 1000.0, 800.0, code_tolerance=0.02, noise=1.0)
    return found.select("field", "parity", "n_match", F.round("crval_ra", 1).alias("ra"), F.round("crval_dec", 1).alias("dec"), F.round("scale", 0).alias("scale"))


@query()
def index_quads(spark, sf):
    """Features of an index over the stars."""
    return build_index.build_index(customers(spark, sf).select("id", "ra", "dec", "mag"), "id", "ra", "dec", "mag", (180.0, 900.0), nside=4).quads


# ---- images --------------------------------------------------------------------------------------

PIXELS_SQL = f"(SELECT cast(floor(p_partkey / 400.0) as bigint) AS image, p_partkey % 20 AS x, cast(floor(p_partkey / 20.0) as bigint) % 20 AS y, p_retailprice AS value, {_frac('p_partkey', 0.3819660112501051)} AS shift FROM part)"


def _pixels(spark, sf):
    return _of(spark, sf, "part", PIXELS_SQL)


@query(f"SELECT image, cast(floor(x / 4.0) as bigint) AS bx, cast(floor(y / 4.0) as bigint) AS iy, round(avg(value), 6) AS value FROM {PIXELS_SQL} p GROUP BY 1, 2, 3")
def block_average(spark, sf):
    """Block averages of images in long form."""
    return images.pixel_blocks(_pixels(spark, sf), 4).select("image", "bx", F.col("by").alias("iy"), F.round("value", 6).alias("value"))


_LX, _LY = images.lanczos("(x - tx)", 2), images.lanczos("(y - ty)", 2)


@query(f"""SELECT x, y, round(sum(k * value) / sum(k), 5) AS value FROM (SELECT *, {_LX} * {_LY} AS k FROM (SELECT value, tx, ty, cast(floor(tx) as bigint) + ox AS x, cast(floor(ty) as bigint) + oy AS y
  FROM (SELECT value, x + shift AS tx, y + shift / 2 AS ty FROM {PIXELS_SQL} p) q CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS ox) a CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS oy) b) r) s
  GROUP BY x, y HAVING x BETWEEN 2 AND 17 AND y BETWEEN 2 AND 17""")
def coadd_images(spark, sf):
    """Images placed with shifts and added with Lanczos weights; the border is left out."""
    p = _pixels(spark, sf).selectExpr("value", "x + shift AS tx", "y + shift / 2 AS ty", "1.0D AS weight")
    return images.coadd(p, "tx", "ty", order=2).where("x BETWEEN 2 AND 17 AND y BETWEEN 2 AND 17").select("x", "y", F.round("value", 5).alias("value"))


@query()
def source_extraction(spark, sf):
    """Sources of small made-up images, a Gaussian per part on a noisy ground, all pixels as rows."""
    p = _read(spark, sf, "part").repartition(shuffle_partitions(spark), "p_partkey")  # a small file is one task, its pixels are many
    p = p.selectExpr("p_partkey AS image", "8 + p_partkey % 13 AS cx", "8 + p_partkey % 11 AS cy", "p_retailprice AS flux", "explode(sequence(0, 1023)) AS i")
    value = "flux * exp(-0.5 * (pow(i % 32 - cx, 2) + pow(floor(i / 32) - cy, 2))) + pmod(hash(image, i), 1000) / 100.0"
    return images.source_table(p.selectExpr("image", "cast(i % 32 as bigint) AS x", "cast(floor(i / 32) as bigint) AS y", f"cast({value} as double) AS value"))


@query(f"""WITH p AS {PIXELS_SQL}, a AS (SELECT q.image, q.x, q.y, sum(p.value * exp(-0.5 * (q.x - p.x) * (q.x - p.x))) AS total, sum(exp(-0.5 * (q.x - p.x) * (q.x - p.x))) AS norm FROM p q JOIN p ON q.image = p.image AND q.y = p.y AND abs(q.x - p.x) <= 3 GROUP BY 1, 2, 3)
  SELECT q.image, q.x, q.y, round(sum(a.total * exp(-0.5 * (q.y - a.y) * (q.y - a.y))) / sum(a.norm * exp(-0.5 * (q.y - a.y) * (q.y - a.y))), 6) AS value FROM a q JOIN a ON q.image = a.image AND q.x = a.x AND abs(q.y - a.y) <= 3 GROUP BY 1, 2, 3""")
def smoothed_images(spark, sf):
    """Images smoothed along rows, then columns."""
    return images.smoothed(_pixels(spark, sf), 1.0).select("image", "x", "y", F.round("value", 6).alias("value"))


@query(f"""WITH RECURSIVE m AS (SELECT image, x, y FROM {PIXELS_SQL} p WHERE sin(x * 0.7 + image) * cos(y * 0.9) > 0.2),
  r AS (SELECT image, x, y, image * 400 + y * 20 + x AS k FROM m UNION SELECT m.image, m.x, m.y, r.k FROM r JOIN m ON m.image = r.image AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1 WHERE r.k < m.image * 400 + m.y * 20 + m.x),
  l AS (SELECT image, x, y, min(k) AS k FROM r GROUP BY 1, 2, 3)
  SELECT image, x, y, cast(dense_rank() OVER (PARTITION BY image ORDER BY k) as integer) AS object FROM (
    SELECT l.image, l.x, l.y, l.k FROM l) o""")
def image_objects(spark, sf):
    """Connected objects of a mask, numbered in reading order."""
    return images.object_labels(_pixels(spark, sf).where("sin(x * 0.7 + image) * cos(y * 0.9) > 0.2"))


# ---- service -------------------------------------------------------------------------------------

_JOBS = "(SELECT event_id AS job_id, user_id AS image_id, CASE WHEN value > 60 THEN event_id END AS calibration_id, ts AS end_time, event_type AS status FROM events)"


def _jobs(spark, sf):
    return _read(spark, sf, "events").selectExpr("event_id AS job_id", "user_id AS image_id", "CASE WHEN value > 60 THEN event_id END AS calibration_id", "ts AS end_time", "event_type AS status")


@query("SELECT doc_id AS image_id, n_chars FROM documents WHERE lower(source) = 'src3'")
def tag_search(spark, sf):
    """Images with a tag, in any case."""
    d = _read(spark, sf, "documents")
    return web.images_by_tag(d.selectExpr("doc_id AS image_id", "n_chars"), d.selectExpr("doc_id AS image_id", "source AS tag"), "SRC3")


@query("SELECT source AS tag, count(DISTINCT doc_id) AS n FROM documents GROUP BY source ORDER BY n DESC, tag LIMIT 35")
def popular_tags(spark, sf):
    """The 35 most used tags."""
    return web.popular_tags(_read(spark, sf, "documents").selectExpr("doc_id AS image_id", "source AS tag"))


@query("SELECT source AS tag, count(*) AS n FROM documents WHERE source LIKE 'src1%' GROUP BY source ORDER BY n DESC, tag LIMIT 8")
def tag_autocomplete(spark, sf):
    """Tags by prefix."""
    return web.autocomplete(_read(spark, sf, "documents").selectExpr("doc_id AS image_id", "source AS tag"), "SRC1")


@query("SELECT doc_id AS image_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unstarted_images(spark, sf):
    """Images without a job."""
    return web.unstarted_images(_read(spark, sf, "documents").selectExpr("doc_id AS image_id"), _read(spark, sf, "labels").selectExpr("doc_id AS image_id"))


@query("SELECT c_custkey AS image_id, count(o_orderkey) AS jobs FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def job_counts(spark, sf):
    """Jobs of each image, zero included."""
    return web.job_counts(_read(spark, sf, "customer").selectExpr("c_custkey AS image_id"), _read(spark, sf, "orders").selectExpr("o_custkey AS image_id"))


@query(f"SELECT image_id, job_id, calibration_id IS NOT NULL AS solved FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY calibration_id IS NOT NULL DESC, end_time DESC, job_id DESC) AS k FROM {_JOBS} j) s WHERE k = 1")
def best_job(spark, sf):
    """One job per image: solved before unsolved, then the latest."""
    return web.best_jobs(_jobs(spark, sf))


@query(f"""SELECT c_custkey AS image_id, c_nationkey AS user_id, c_custkey % 3 = 0 AS public FROM customer
  WHERE (c_custkey % 3 = 0 OR c_nationkey = 7) AND (c_nationkey % 2 = 0 OR c_custkey IN (SELECT image_id FROM {_JOBS} j WHERE calibration_id IS NOT NULL))""")
def visible_images(spark, sf):
    """Images that user 7 may see."""
    i = _read(spark, sf, "customer").selectExpr("c_custkey AS image_id", "c_nationkey AS user_id", "c_custkey % 3 = 0 AS public")
    u = _read(spark, sf, "nation").selectExpr("n_nationkey AS user_id", "n_nationkey % 2 = 1 AS anonymous")
    return web.visible_images(i, u, web.best_jobs(_jobs(spark, sf)), 7)


@query(f"SELECT a.id, round(a.r, 6) AS r FROM (SELECT *, abs(mag) / 1000 AS r FROM {CUSTOMERS} s) a JOIN (SELECT cos(radians(-20.0)) * cos(radians(10.0)) AS x, cos(radians(-20.0)) * sin(radians(10.0)) AS y, sin(radians(-20.0)) AS z) b ON {D3} < {_chord2(15.0)} AND a.r <= 15")
def near_place(spark, sf):
    """Calibrations near a place."""
    return web.near_place(customers(spark, sf).withColumn("r", F.expr("abs(mag) / 1000")), 10.0, -20.0, 15.0).select("id", F.round("r", 6).alias("r"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def third_page(spark, sf):
    """Page three of twenty rows."""
    return web.page(_read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 20)


# ---- streams -------------------------------------------------------------------------------------


@query("SELECT user_id AS field, bool_or(value > 90) AS solved, cast(least(3, count(*)) as integer) AS tries FROM events GROUP BY user_id")
def solved_stream(spark, sf):
    """Keyed solved flags after a stream of results has run dry."""
    e = _read(spark, sf, "events").selectExpr("user_id AS field", "value > 90 AS solved")
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    e.write.parquet(f"{base}/in")
    files = len(spark.read.parquet(f"{base}/in").inputFiles())
    out = jobs.solved_state(jobs.job_stream(spark, f"{base}/in", "field long, solved boolean", max(2, -(-files // 8))))  # eight batches at most, however many files
    q = out.writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("field").agg(F.max(F.struct("batch", "solved", "tries")).alias("last"))
    return last.select("field", "last.solved", "last.tries")
