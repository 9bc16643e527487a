"""Spatial joins: radius, ring, nearest and counts, in N dimensions and on the sphere; clusters.

A radius join puts both sides on a grid of cells one radius wide. The left side visits the
neighbouring cells, so each qualifying pair meets in exactly one cell and an equi-join plus a
residual distance test finds all pairs without a cross product. The grid is over at most three
coordinates; more of them prune little and only take part in the distance.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweft.functions import geometry, sky
from skyweft.operators.components import connected_components
from skyweft.session import materialize, shuffle_partitions


def _renamed(df: DataFrame, id_col: str, coords: Sequence[str], prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    kept = [F.col(c).alias(f"{prefix}_{c}") for c in keep]
    return df.select(F.col(id_col).alias(f"{prefix}_id"), *[F.col(c).cast("double").alias(f"{prefix}{i}") for i, c in enumerate(coords)], *kept)


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables that are dealt by ``keys`` to the session's number of tasks, neither of them broadcast.

    The planner guesses the size of derived rows from the compressed files they come from, which is far too
    small, and AQE joins tasks by bytes, which say nothing of the pairs that a join makes.
    """
    n = shuffle_partitions(left.sparkSession)
    return left.repartition(n, *keys).hint("merge").join(right.repartition(n, *keys).hint("merge"), list(keys))


def runs_of(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows of a sorted batch that have the same keys, which are not null."""
    n = batch.num_rows
    new = np.any([pc.not_equal(batch[c].slice(1), batch[c].slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in keys], axis=0) if n > 1 else np.zeros(0, bool)
    for lo, hi in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), n] if n else []):
        yield batch.slice(lo, hi - lo)


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    coords: Sequence[str],
    left_id: str = "id",
    right_id: str = "id",
    min_radius: float | None = None,
    not_self: bool = False,
    right_coords: Sequence[str] | None = None,
    left_keep: Sequence[str] = (),
    right_keep: Sequence[str] = (),
    places: bool = False,
    reach: str | None = None,
    grid_dims: int = 3,
    width: float = 1.0,
    block: int = 1,
) -> DataFrame:
    """``(l_id, r_id, dist2)`` for all pairs with ``min_radius <= distance <= radius`` (both ends in).

    ``not_self`` drops pairs of equal ids. Rows with a null or NaN coordinate match nothing: a null has no
    cell, and NaN is greater than any radius. The left side is the one that visits, so it should be
    the smaller one. Columns named in ``left_keep`` and ``right_keep`` come along as ``l_<name>`` and ``r_<name>``, with
    ``places`` the coordinates too, as ``l0, l1, ..`` and ``r0, r1, ..``. A row of the left side looks no farther than its own
    ``reach``, a column, where one is named. The grid is over ``grid_dims`` coordinates, of cells ``width`` radii wide: wide cells
    mean fewer copies of the left side and more pairs to test. With ``block`` rows are dealt by blocks of so many cells to each
    side, and copied for each cell, and grouped by it, where they lie then: fewer copies are shuffled, and a block has to be one of many.
    """
    if not radius > 0:
        raise ValueError("radius is positive")
    dims = range(len(coords))
    grid = range(min(grid_dims, len(coords)))
    a = _renamed(left, left_id, coords, "l", [*left_keep, *([reach] if reach and reach not in left_keep else [])])
    b = _renamed(right, right_id, right_coords or coords, "r", right_keep)
    side = float(radius) * width
    cell = lambda c: F.floor(c / F.lit(side))
    far = F.least(F.lit(float(radius)), F.col(f"l_{reach}")) if reach else F.lit(float(radius))
    visits = a.withColumn("far", far * (1 + 1e-9))
    ends = {i: [cell(F.col(f"l{i}") + o * F.col("far")) for o in (-1, 1)] for i in grid}
    homes = b.select("*", *[cell(F.col(f"r{i}")).alias(f"c{i}") for i in grid])
    d2 = reduce(operator.add, [(F.col(f"l{i}") - F.col(f"r{i}")) * (F.col(f"l{i}") - F.col(f"r{i}")) for i in dims])
    near = d2 <= float(radius) ** 2
    if min_radius is not None:
        near &= d2 >= float(min_radius) ** 2
    if not_self:
        near &= F.col("l_id") != F.col("r_id")
    more = [f"l_{c}" for c in left_keep] + [f"r_{c}" for c in right_keep] + ([f"{p}{i}" for p in "lr" for i in dims] if places else [])
    cells = [f"c{i}" for i in grid]
    if block == 1:
        for i in grid:
            visits = visits.withColumn(f"c{i}", F.explode(F.sequence(*ends[i])))
        return dealt_join(visits.drop("far"), homes, cells).where(near).select("l_id", "r_id", d2.alias("dist2"), *more)
    for i in grid:
        visits = visits.withColumns({f"f{i}": ends[i][0], f"t{i}": ends[i][1]}).withColumn(f"b{i}", F.explode(F.sequence(F.floor(F.col(f"f{i}") / block), F.floor(F.col(f"t{i}") / block))))
        homes = homes.withColumns({f"f{i}": F.col(f"c{i}"), f"t{i}": F.col(f"c{i}"), f"b{i}": F.floor(F.col(f"c{i}") / block)})
    return _met_in_cells(visits.drop("far"), homes.drop(*cells), a.columns, b.columns, len(grid), block).where(near).select("l_id", "r_id", d2.alias("dist2"), *more)


def _met_in_cells(left: DataFrame, right: DataFrame, l_cols: Sequence[str], r_cols: Sequence[str], dims: int, block: int) -> DataFrame:
    """Pairs of rows that share a cell of their block ``b0, b1, ..``: a row takes the cells ``f0`` to ``t0``, ``f1`` to ``t1``, .. of it.

    Sides, which have no column in common but these, are dealt by blocks together; a cell's rows of both are lists of one row then.
    There are four times the session's tasks, as the rows of cells, which are several times those dealt, are grouped in a task's memory.
    """
    n, blocks, cells = 4 * shuffle_partitions(left.sparkSession), [f"b{i}" for i in range(dims)], [f"c{i}" for i in range(dims)]
    side = lambda df, p, cols: df.select(*blocks, *[f"{e}{i}" for i in range(dims) for e in "ft"], F.struct(*cols).alias(p))
    both = side(left, "l", l_cols).unionByName(side(right, "r", r_cols), allowMissingColumns=True).repartition(n, *blocks)
    for i in range(dims):
        first, last = F.greatest(f"f{i}", F.col(f"b{i}") * block), F.least(f"t{i}", F.col(f"b{i}") * block + block - 1)
        both = both.withColumn(f"c{i}", F.explode(F.sequence(first, last)))
    met = both.groupBy(*blocks, *cells).agg(F.collect_list("l").alias("l"), F.collect_list("r").alias("r")).where("size(l) > 0 AND size(r) > 0")
    return met.select("r", F.inline("l").alias(*l_cols)).select(*l_cols, F.inline("r").alias(*r_cols))


def sky_radius_join(left: DataFrame, right: DataFrame, radius_deg: float, **how) -> DataFrame:
    """Radius join of unit vectors x, y, z; ``(l_id, r_id, dist_deg)``."""
    low = how.pop("min_deg", None)
    pairs = radius_join(left, right, math.sqrt(sky.chord2_of_deg(radius_deg)), ("x", "y", "z"), min_radius=None if low is None else math.sqrt(sky.chord2_of_deg(low)), **how)
    return pairs.select("l_id", "r_id", F.expr(sky.deg_of_chord2("dist2")).alias("dist_deg"))


def nearest_in_radius(left: DataFrame, right: DataFrame, radius: float, coords: Sequence[str], left_id: str = "id", **how) -> DataFrame:
    """For each left row with a match: ``(l_id, r_id, dist2, n)``, the nearest right row and how many lie within.

    Equal distances go to the smallest right id. The count is strict (distance < radius), the nearest inclusive.
    Two joins: distances and counts are added up as numbers, a row a left id however many pairs there are; then
    the ids at the least distance are looked for no farther than that.
    """
    pairs = radius_join(left, right, radius, coords, left_id=left_id, **how)
    inside = F.sum(F.when(F.col("dist2") < float(radius) ** 2, 1).otherwise(0)).alias("n")
    best = pairs.groupBy("l_id").agg(F.min("dist2").alias("best2"), inside)
    best = best.withColumn("best", F.sqrt("best2") * (1 + 1e-9))
    own = left.select(F.col(left_id).alias("l_id"), *coords).hint("merge").join(best.hint("merge"), "l_id")
    again = radius_join(own, right, radius, coords, left_id="l_id", left_keep=["best2", "n"], reach="best", **how)
    return again.where("dist2 = l_best2").groupBy("l_id").agg(F.min("r_id").alias("r_id"), F.min("l_best2").alias("dist2"), F.min("l_n").alias("n")).select("l_id", "r_id", "dist2", "n")


def count_in_radius(left: DataFrame, right: DataFrame, radius: float, coords: Sequence[str], left_id: str = "id", **how) -> DataFrame:
    """``(l_id, n)`` for every left row, zero where nothing lies within."""
    counts = radius_join(left, right, radius, coords, left_id=left_id, **how).groupBy("l_id").agg(F.count(F.lit(1)).alias("n"))
    return left.select(F.col(left_id).alias("l_id")).hint("merge").join(counts.hint("merge"), "l_id", "left").select("l_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def match_lists(left: DataFrame, right: DataFrame, radius: float, coords: Sequence[str], left_id: str = "id", **how) -> DataFrame:
    """``(l_id, matches)``: sorted right ids of each left row, null where there are none."""
    lists = radius_join(left, right, radius, coords, left_id=left_id, **how).groupBy("l_id").agg(F.array_sort(F.collect_list("r_id")).alias("matches"))
    return left.select(F.col(left_id).alias("l_id")).hint("merge").join(lists.hint("merge"), "l_id", "left")


def nearest(left: DataFrame, right: DataFrame, coords: Sequence[str], first_radius: float, left_id: str = "id", right_id: str = "id", rounds: int = 12) -> DataFrame:
    """``(l_id, r_id, dist2)``: the nearest right row of every left row, without a radius given.

    Joins within a radius that grows fourfold each round and keeps only the rows still unmatched, so most
    rows meet few candidates. Rows left after all rounds (isolated ones) meet all others in one last
    round that spans the data. Rows with a null or NaN coordinate have no nearest one, rows of one id count once.
    """
    known = reduce(operator.and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])
    left, right = left.select(left_id, *coords).where(known).dropDuplicates([left_id]), right.where(known)
    todo, out, r = left, None, float(first_radius)
    span = right.agg(*[(F.max(c) - F.min(c)).alias(c) for c in coords]).first()
    wide = left.agg(*[F.max(F.abs(c)).alias(c) for c in coords]).first()
    if span[0] is None:
        return left.sparkSession.createDataFrame([], "l_id long, r_id long, dist2 double")
    limit = 2 * math.sqrt(sum((abs(span[c] or 0) + abs(wide[c] or 0)) ** 2 for c in coords)) + r
    while True:
        got = materialize(nearest_in_radius(todo, right, r, coords, left_id=left_id, right_id=right_id).drop("n"), "nearest")
        out = got if out is None else out.unionByName(got)
        rounds -= 1
        if r >= limit or left.count() == out.count():
            return out
        todo = todo.join(got.select(F.col("l_id").alias(left_id)), left_id, "left_anti")
        r = limit if rounds <= 1 else r * 4


def join_by(left: DataFrame, right: DataFrame, distance2: Column, radius: float, coords: Sequence[str], reach: float | None = None, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Radius join under another distance: ``distance2`` is its square over columns ``l0, l1, ..`` and ``r0, r1, ..``.

    ``reach`` is the Euclidean distance that no qualifying pair exceeds (by default ``radius``).
    """
    pairs = radius_join(left, right, float(reach or radius), coords, left_id, right_id, places=True)
    return pairs.select("l_id", "r_id", distance2.alias("dist2")).where(F.col("dist2") <= float(radius) ** 2)


def array_distance2(a: str, b: str) -> Column:
    """Squared distance of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


#: Rows of a block in a join of arrays at most; fewer where blocks would not do for the session's tasks, but no fewer than the other number.
BLOCK, LEAST_BLOCK = 8192, 256


def array_radius_join(left: DataFrame, right: DataFrame, radius: float, vec: str, left_id: str, right_id: str, grid_dims: int = 1, not_self: bool = False, strips: int = 4, ordered: bool = False) -> DataFrame:
    """Radius join of array columns of many dimensions; ``ordered`` returns the pairs with ``l_id < r_id`` only.

    The grid is over the ``grid_dims`` dimensions in which the right side spreads most. In many dimensions no grid prunes much, so
    both sides are cut into blocks too, and every pair of blocks is a key of the join: the pairs are dealt to all tasks, however few cells
    there are, and a task holds one block. Distances are added up in ``strips`` parts of the dimensions, the widest first, in generated code; a pair is
    given up as soon as a part exceeds the radius. Arrays of another length than the right side's longest, or that hold null, NaN or an infinity, match nothing.
    """
    size = right.agg(F.max(F.size(vec)).alias("n")).first()["n"] or 0
    if size <= 0:
        return left.select(F.col(left_id).alias("l_id"), F.col(left_id).alias("r_id"), F.lit(0.0).alias("dist2")).where("false")
    # columns without nulls: code with a branch for each of them is too long to be compiled
    number = lambda i: F.coalesce(F.get(F.col(vec), F.lit(i)).cast("double"), F.lit(float("nan")))
    whole = (F.size(vec) == size) & F.forall(vec, lambda v: F.abs(v.cast("double")) < float("inf"))
    cols = lambda df, id_col, p: df.where(whole).select(F.col(id_col).alias(f"{p}_id"), *[number(i).alias(f"{p}{i}") for i in range(size)])
    a, b = cols(left, left_id, "l"), cols(right, right_id, "r")
    seen = b.agg(F.count(F.lit(1)).alias("n"), *[f(f"r{i}").alias(f"{k}{i}") for i in range(size) for k, f in (("v", F.var_pop), ("lo", F.min), ("hi", F.max))]).first()
    rows = (a.count(), seen["n"])
    if not all(rows):
        return a.select("l_id", F.col("l_id").alias("r_id"), F.lit(0.0).alias("dist2")).where("false")
    order = sorted(range(size), key=lambda i: -seen[f"v{i}"])
    grid = order[: min(grid_dims, size)]
    tasks = math.ceil(math.sqrt(2 * shuffle_partitions(left.sparkSession)))
    blocks = [max(-(-n // BLOCK), min(tasks, -(-n // LEAST_BLOCK))) for n in rows]
    for i in grid:
        lo, hi = (math.floor(seen[f"{k}{i}"] / radius) for k in ("lo", "hi"))
        around = F.filter(F.array(*[F.floor(F.col(f"l{i}") / radius) + o for o in (-1, 0, 1)]), lambda c: c.between(lo, hi))  # noqa: B023
        a = a.withColumn(f"c{i}", F.explode(around))
    b = b.withColumns({f"c{i}": F.floor(F.col(f"r{i}") / radius) for i in grid})
    own = lambda n: (F.monotonically_increasing_id() % n).cast("int")  # noqa: E731  rows of one file in turn
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = a.withColumn("lb", own(blocks[0])).withColumn("rb", every(blocks[1]))
    b = b.withColumn("rb", own(blocks[1])).withColumn("lb", every(blocks[0]))
    pairs = dealt_join(a, b, ["lb", "rb", *[f"c{i}" for i in grid]])
    if not_self or ordered:
        pairs = pairs.where("l_id < r_id" if ordered else "l_id <> r_id")
    step, upto = -(-size // strips), None
    for k in range(0, size, step):
        part = reduce(operator.add, [(F.col(f"l{i}") - F.col(f"r{i}")) * (F.col(f"l{i}") - F.col(f"r{i}")) for i in order[k : k + step]])
        upto = part if upto is None else F.col("upto") + part
        rest = [f"{p}{i}" for i in order[k + step :] for p in "lr"]
        pairs = pairs.select("l_id", "r_id", *rest, upto.alias("upto")).where(F.col("upto") <= radius * radius)
    return pairs.select("l_id", "r_id", F.col("upto").alias("dist2"))


def friends_of_friends(points: DataFrame, radius: float, coords: Sequence[str], id_col: str = "id", singletons: bool = True) -> DataFrame:
    """``(id, group_id)``: connected components of the radius self-join; group_id is the smallest member.

    The points of a cell whose diagonal is below the radius are all friends, so a cell stands in the graph as its smallest id, and
    pairs of points are pairs of cells before they are shuffled: the graph grows with the cells taken, not with the pairs.
    """
    side = float(radius) / math.sqrt(len(coords)) * (1 - 1e-6)
    cells = [f"c{i}" for i in range(len(coords))]
    known = reduce(operator.and_, [F.col(f"l{i}").isNotNull() & ~F.isnan(f"l{i}") for i in range(len(coords))])
    p = _renamed(points, id_col, coords, "l").where(known & F.col("l_id").isNotNull()).withColumns({c: F.floor(F.col(f"l{i}") / side) for i, c in enumerate(cells)})
    heads = p.groupBy(*cells).agg(F.min("l_id").alias("head"), F.max("l_id").alias("last"))
    p = p.hint("merge").join(heads.hint("merge"), cells).select("l_id", *[f"l{i}" for i in range(len(coords))], "head", (F.col("head") != F.col("last")).alias("many"))
    p = materialize(p, "friends")
    spots = p.select("head", *[f"l{i}" for i in range(len(coords))]).distinct()
    edges = radius_join(spots, spots, radius, [f"l{i}" for i in range(len(coords))], "head", "head").where("l_id < r_id").select("l_id", "r_id")
    ids = materialize(p.groupBy("l_id").agg(F.min("head").alias("head"), F.max("head").alias("other"), F.max("many").alias("many")), "friend-ids")
    again = ids.where("head <> other").select("l_id")  # an id at several places joins their cells
    own = p.join(again.hint("merge"), "l_id").join(ids.select("l_id", F.col("head").alias("first")).hint("merge"), "l_id").where("head <> first").select(F.col("first").alias("l_id"), F.col("head").alias("r_id"))
    groups = connected_components(edges.unionByName(own), "l_id", "r_id").select(F.col("node").alias("head"), "component")
    found = ids.hint("merge").join(groups.hint("merge"), "head", "left").where("many OR component IS NOT NULL").select(F.col("l_id").alias("id"), F.coalesce("component", "head").alias("group_id"))
    if not singletons:
        return found
    every = points.select(F.col(id_col).alias("id")).distinct()
    return every.hint("merge").join(found.hint("merge"), "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


#: Parts that a cell of a segment's level is cut into to each side: a segment of that level lies in some twenty of the small cells.
CUTS = 16
#: Small cells to each side of a block, by which segments are dealt: a segment of that level meets two or three blocks to each side at most.
BLOCKED = 8
#: Segments a task at most, on average: the rows of their small cells are grouped in its memory.
DEALT = 50_000


def segment_crossings(left: DataFrame, right: DataFrame, cell: float, ends: Sequence[str] = ("x0", "y0", "x1", "y1"), left_id: str = "id", right_id: str = "id", ordered: bool = False) -> DataFrame:
    """``(l_id, r_id, x, y)``: where the segments of two tables cross inside both; touching at an end is no crossing.

    A segment's level is that of the smallest cells, ``cell`` times a power of two, that are as wide as its
    bounding box. A pair meets at the level of its longer segment: that one stands in its own cells and the shorter
    one visits them. These are cut into CUTS small cells to each side, of which a segment takes only those that it runs
    through, some 3 CUTS a level at most, however long it is, so that few pairs meet that do not cross. Of the small
    cells that a pair shares only the one of its crossing counts. What is shuffled is a row for each block of small cells that a segment meets.
    Segments with a null, NaN or infinite end cross nothing. ``ordered`` returns the pairs with ``l_id < r_id`` only.
    """
    if not cell > 0:
        raise ValueError("cell is positive")

    def placed(df: DataFrame, id_col: str, p: str) -> DataFrame:
        s = df.select(F.col(id_col).alias(f"{p}_id"), *[F.col(c).cast("double").alias(f"{p}{i}") for i, c in enumerate(ends)])
        s = s.where(reduce(operator.and_, [F.abs(f"{p}{i}") < float("inf") for i in range(4)]))
        extent = F.greatest(F.abs(F.col(f"{p}2") - F.col(f"{p}0")), F.abs(F.col(f"{p}3") - F.col(f"{p}1")))
        level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(extent, F.lit(cell)) / cell)).cast("int"))
        return s.withColumn(f"{p}n", level)

    def wide(s: DataFrame) -> DataFrame:
        """A row for each block of BLOCKED x BLOCKED small cells that a segment's box meets, of the level in ``level``."""
        slack = F.greatest(*[F.abs(f"s{i}") for i in range(4)], F.col("size")) * 1e-9
        s = s.withColumn("size", F.pow(F.lit(2.0), F.col("level")) * (cell / CUTS)).withColumn("slack", slack)
        s = s.withColumns({"from": F.floor((F.least("s0", "s2") - F.col("slack")) / F.col("size")), "to": F.floor((F.greatest("s0", "s2") + F.col("slack")) / F.col("size"))})
        s = s.withColumn("u", F.explode(F.sequence(F.floor(F.col("from") / BLOCKED), F.floor(F.col("to") / BLOCKED))))
        edges = [F.floor(y / F.col("size") / BLOCKED) for y in (low - spread, high + spread)]
        return s.withColumn("v", F.explode(F.sequence(*edges)))

    x0, y0, x1, y1 = (F.col(f"s{i}") for i in range(4))
    low, high = F.least(y0, y1), F.greatest(y0, y1)
    steep = (y1 - y0) / F.when(x1 != x0, x1 - x0)
    spread = F.col("slack") * (1 + F.coalesce(F.least(F.abs(steep), (high - low) / F.col("slack")), F.lit(0.0)))

    def cells(s: DataFrame) -> DataFrame:
        """A row for each small cell of its block that a segment runs through, or passes within ``slack``: columns first, then the rows it has in each."""
        first, last = F.greatest("from", F.col("u") * BLOCKED), F.least("to", F.col("u") * BLOCKED + BLOCKED - 1)
        s = s.where(first <= last).withColumn("cu", F.explode(F.sequence(first, last)))
        at = lambda x: F.coalesce(F.least(high, F.greatest(low, y0 + (x - x0) * steep)), low)
        edge = lambda k: at(F.greatest(F.least(x0, x1), F.least(F.greatest(x0, x1), (F.col("cu") + k) * F.col("size"))))
        upright = F.abs(x1 - x0) <= 100 * F.col("slack")  # its slope, and the crossing of short ones, are not exact enough
        s = s.withColumns({"e0": F.when(upright, low).otherwise(edge(0)), "e1": F.when(upright, high).otherwise(edge(1))})
        s = s.withColumns({"down": F.floor((F.least("e0", "e1") - spread) / F.col("size")), "up": F.floor((F.greatest("e0", "e1") + spread) / F.col("size"))})
        first, last = F.greatest("down", F.col("v") * BLOCKED), F.least("up", F.col("v") * BLOCKED + BLOCKED - 1)
        return s.where(first <= last).withColumn("cv", F.explode(F.sequence(first, last)))

    a, b = placed(left, left_id, "l"), placed(right, right_id, "r")
    seen = a.select(F.col("ln").alias("n")).unionByName(b.select(F.col("rn").alias("n"))).agg(F.max("n").alias("top"), F.count("n").alias("n")).first()
    top = seen["top"] or 0
    above = lambda p, k: F.explode(F.sequence(F.col(f"{p}n") + k, F.lit(top)))
    l, r = (tuple(f"{p}{i}" for i in range(4)) for p in "lr")  # noqa: E741
    x, y = geometry.line_crossing(l, r)
    keys = ["level", "u", "v", "cu", "cv"]
    # the column of the crossing, of those that both take, and the row in it: rounding does not lead out of the cells shared
    once = " AND ".join(f"{c} = greatest(l{f}, r{f}, least(l{t}, r{t}, cast(floor({v} / size) as bigint)))" for c, f, t, v in (("cu", "from", "to", x), ("cv", "down", "up", y)))
    n = max(shuffle_partitions(left.sparkSession), -(-seen["n"] // DEALT))

    def meeting(a: DataFrame, b: DataFrame) -> DataFrame:
        """Segments are dealt by blocks; the many rows of their small cells are made and grouped where they lie then."""
        sides = [s.select("level", F.col(f"{p}_id").alias(f"{p}_id"), *[F.col(f"{p}{i}").alias(f"s{i}") for i in range(4)], F.lit(p).alias("side")) for s, p in ((a, "l"), (b, "r"))]
        both = cells(wide(sides[0].unionByName(sides[1], allowMissingColumns=True)).repartition(n, "level", "u", "v"))
        what = ["s0", "s1", "s2", "s3", "from", "to", "down", "up"]
        own = lambda p: F.collect_list(F.when(F.col("side") == p, F.struct(f"{p}_id", *what))).alias(p)
        each = lambda p: F.inline(p).alias(f"{p}_id", *[f"{p}{c.removeprefix('s')}" for c in what])
        met = both.groupBy(*keys, "size").agg(own("l"), own("r")).where("size(l) > 0 AND size(r) > 0")
        near = met.select("size", "cu", "cv", "r", each("l")).select("*", each("r")).drop("r")
        return (near.where("l_id < r_id") if ordered else near).where(geometry.segments_cross(l, r)).where(once)

    pairs = meeting(a.withColumn("level", F.col("ln")), b.withColumn("level", above("r", 0)))
    if top:
        pairs = pairs.unionByName(meeting(a.where(F.col("ln") < top).withColumn("level", above("l", 1)), b.withColumn("level", F.col("rn"))))
    return pairs.select("l_id", "r_id", F.expr(x).alias("x"), F.expr(y).alias("y"))


def in_box(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows inside a box, both ends in; reaches the scan as a filter."""
    for c, (lo, hi) in limits.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def within(rows: DataFrame, centre: Sequence[float], radius: float, coords: Sequence[str], out: str = "dist2", near_first: bool = False) -> DataFrame:
    """The rows within ``radius`` (inclusive) of a place in any number of dimensions, with the squared distance.

    The box around the ball reaches the scan as a filter, so files and row groups outside it are not read.
    Rows with a null or NaN coordinate are outside; a radius below zero finds none.
    """
    if len(centre) != len(coords):
        raise ValueError("a place has a number for each coordinate")
    r = float(radius)
    side = {c: abs(r) + 1e-12 * (abs(float(v)) + abs(r)) for c, v in zip(coords, centre, strict=True)}  # rounding of the ends
    near = in_box(rows, {c: (float(v) - side[c], float(v) + side[c]) for c, v in zip(coords, centre, strict=True)})
    d2 = reduce(operator.add, [(F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(coords, centre, strict=True)])
    got = near.withColumn(out, d2).where((F.col(out) <= r * r) & F.lit(r >= 0))
    return got.orderBy(out) if near_first else got


def nearest_to(rows: DataFrame, centre: Sequence[float], coords: Sequence[str], id_col: str = "id", n: int = 1, radius: float | None = None, first_radius: float | None = None, rounds: int = 8, out: str = "dist2") -> DataFrame:
    """The ``n`` rows nearest to a place, nearest first, ties to the smaller id; within ``radius`` (inclusive) where one is given.

    With ``first_radius`` the search looks in a box that grows fourfold until it holds ``n`` rows, and reads only
    what meets the box; after ``rounds`` boxes, and without ``first_radius``, one pass over all rows
    decides. Every pass keeps ``n`` rows a task. Rows with a null or NaN coordinate take no part.
    """
    if n < 1:
        raise ValueError("n is positive")
    order = [F.col(out), F.col(id_col)]
    reach = float(first_radius) if first_radius else None
    if reach is not None and not reach > 0:
        raise ValueError("first_radius is positive")
    for _ in range(rounds if reach else 0):
        reach = reach if radius is None else min(reach, float(radius))
        got = within(rows, centre, reach, coords, out).orderBy(*order).limit(n)
        if radius is not None and reach >= radius or within(rows, centre, reach, coords, out).limit(n).count() == n:
            return got
        reach *= 4
    if radius is not None:
        return within(rows, centre, radius, coords, out).orderBy(*order).limit(n)
    known = reduce(operator.and_, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in coords])
    d2 = reduce(operator.add, [(F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(coords, centre, strict=True)])
    return rows.where(known).withColumn(out, d2).orderBy(*order).limit(n)


def cone_search(stars: DataFrame, ra: float, dec: float, radius_deg: float, cell_col: str | None = None, nside: int = 0, accept: Column | None = None) -> DataFrame:
    """Stars (x, y, z) within a cone, with their distance; prunes by ``cell_col`` where stars carry cells.

    ``accept`` is a further condition over the stars' columns and ``dist_deg``.
    """
    from skyweft.functions.healpix import cells_within

    x, y, z = (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    if cell_col:
        stars = stars.where(F.col(cell_col).isin(cells_within(x, y, z, radius_deg, nside)))
    d2 = f"(x - {sky.num(x)}) * (x - {sky.num(x)}) + (y - {sky.num(y)}) * (y - {sky.num(y)}) + (z - {sky.num(z)}) * (z - {sky.num(z)})"
    out = stars.withColumn("dist_deg", F.expr(sky.deg_of_chord2(f"({d2})"))).where(F.expr(f"({d2}) <= {sky.num(sky.chord2_of_deg(radius_deg))}"))
    return out if accept is None else out.where(accept)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank_col: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group by ``order``, ranked from 1."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank_col) <= n)
