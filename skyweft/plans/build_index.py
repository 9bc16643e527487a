"""Index building: catalogue -> uniform bright stars per cell -> four-star features -> tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyweft.functions import healpix
from skyweft.functions.sky import num, xyz
from skyweft.operators.quads import normal_form, pixel_code
from skyweft.operators.spatial import radius_join
from skyweft.operators.uniformize import uniformize_dedup, uniformize_top
from skyweft.session import discard, materialize

#: Lower edges of the scale presets, arc minutes (fixed values).
PRESET_EDGES = (0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0, 22.0, 30.0, 42.0, 60.0, 85.0, 120.0, 170.0, 240.0, 340.0, 480.0, 680.0, 1000.0, 1400.0, 2000.0)
FIRST_PRESET = -5
#: Parts of a tile's side between samples.
EDGE_STEPS = 32
#: Rows of the table of fine cells that are broadcast at most (16 bytes each).
BROADCAST_CELLS = 500_000


@dataclass(frozen=True)
class Index:
    stars: DataFrame
    quads: DataFrame
    low_arcmin: float
    high_arcmin: float


def preset_scales(preset: int) -> tuple[float, float]:
    i = preset - FIRST_PRESET
    return PRESET_EDGES[i], PRESET_EDGES[i + 1]


def star_table(catalog: DataFrame, id_col: str, ra: str, dec: str, nside: int) -> DataFrame:
    """Unit vectors and cell beside all other columns of the catalogue."""
    x, y, z = xyz(ra, dec)
    stars = catalog.withColumnRenamed(id_col, "id").withColumns({"x": F.expr(x), "y": F.expr(y), "z": F.expr(z)})
    return healpix.with_cell(stars, nside)


def cell_quads(stars: DataFrame, nside: int, low_arcmin: float, high_arcmin: float, per_cell: int, max_uses: int, loosen: int = 20) -> DataFrame:
    """Up to ``per_cell`` features per cell of the grid: those of the brightest stars whose AB midpoint lies in the cell.

    Candidate pairs come from a ring join; C and D from neighbour lists within the pair's circle. Per
    cell the features of all pairs are ranked by their faintest star and chosen by :func:`_choose`. All
    cells are treated alike, so the result is a valid index that does not depend on a walking order.
    """
    lo, hi = (2 * math.sin(math.radians(a / 60) / 2) for a in (low_arcmin, high_arcmin))
    s = stars.select("id", "x", "y", "z", "rank")
    pairs = radius_join(s, s, hi, ("x", "y", "z"), min_radius=lo, not_self=True).where("l_id < r_id")
    end = lambda p: s.select(F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{c}") for c in ("x", "y", "z", "rank")])
    ab = pairs.join(end("l"), "l_id").join(end("r"), "r_id")
    mid = {c: f"(l{c} + r{c})" for c in "xyz"}
    norm = "sqrt(pow(lx + rx, 2) + pow(ly + ry, 2) + pow(lz + rz, 2))"
    ab = healpix.with_cell(ab.withColumns({f"m{c}": F.expr(f"{mid[c]} / {norm}") for c in "xyz"}), nside, "mx", "my", "mz")
    ab = ab.withColumn("faint", F.greatest("lrank", "rrank"))
    top = ab.withColumn("pair", F.xxhash64("l_id", "r_id")).withColumnRenamed("l_id", "a").withColumnRenamed("r_id", "b")
    east_north, ends, last = tangent_steps()
    for step in (*east_north, ends):
        top = top.withColumns({c: F.expr(e) for c, e in step.items()})
    top = materialize(top, "index-pairs")
    near = radius_join(top, s, hi / 2 * 1.001, ("mx", "my", "mz"), "pair", "id", right_coords=("x", "y", "z"))
    inner = near.select(F.col("l_id").alias("pair"), F.col("r_id").alias("p")).join(top, "pair").where("p <> a AND p <> b").join(s.select(F.col("id").alias("p"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), F.col("rank").alias("prank")), "p")
    for step in last:
        inner = inner.withColumns({c: F.expr(e) for c, e in step.items()})
    inner = materialize(inner.where("u * u - u + v * v - v <= 0").select("pair", "a", "b", "cell", "faint", "p", "prank", "u", "v"), "index-inner")
    one = lambda n, u, v: inner.select("pair", F.col("p").alias(n), F.col("u").alias(u), F.col("v").alias(v), F.col("prank").alias(f"{n}_rank"))
    head = inner.select("pair", "a", "b", "cell", "faint").dropDuplicates(["pair"])
    q = one("c", "cx", "cy").join(one("d", "dx", "dy"), "pair").where("c_rank < d_rank").join(head, "pair")
    q = normal_form(q).withColumn("faint", F.greatest("faint", "d_rank", "c_rank")).withColumn("quad_id", F.xxhash64(F.array_sort(F.array("a", "b", "c", "d"))))
    q = q.withColumn("same", F.row_number().over(Window.partitionBy("quad_id").orderBy("faint", "a", "b"))).where("same = 1")
    q = q.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy("faint", "quad_id"))).select("quad_id", "cell", "k", "a", "b", "c", "d", "cx", "cy", "dx", "dy")
    return _choose(materialize(q, "index-features"), per_cell, max_uses, loosen).drop("k")


def _choose(features: DataFrame, per_cell: int, max_uses: int, loosen: int) -> DataFrame:
    """The first ``per_cell`` features of each cell by ``k`` whose stars are used at most ``max_uses`` times.

    In rounds, each cell that lacks features asks for its next ones without used-up stars; of those that
    ask for one star the first by (k, quad_id) get it. The first of all always does, so rounds end when
    no feature is left to ask for. Then cells that still lack features try with one more use a star, up
    to ``loosen``.
    """
    chosen, limit = features.limit(0), max_uses
    left, n = features, 0
    while True:
        uses = chosen.select(F.explode(F.array("a", "b", "c", "d")).alias("star")).groupBy("star").agg(F.count(F.lit(1)).alias("uses"))
        full = uses.where(F.col("uses") >= limit)
        ask = left
        for star in "abcd":
            ask = ask.join(full.select(F.col("star").alias(star)), star, "left_anti")
        have = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("have"))
        ask = ask.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy("k"))).join(have, "cell", "left")
        ask = materialize(ask.where(F.col("place") + F.coalesce("have", F.lit(0)) <= per_cell).select(*features.columns), "index-ask")
        want = ask.select("quad_id", "k", F.explode(F.array("a", "b", "c", "d")).alias("star")).withColumn("turn", F.row_number().over(Window.partitionBy("star").orderBy("k", "quad_id")))
        over = want.join(uses, "star", "left").where(F.col("turn") + F.coalesce("uses", F.lit(0)) > limit).select("quad_id").distinct()
        chosen = materialize(chosen.unionByName(ask.join(over, "quad_id", "left_anti")), "index-chosen")
        filled = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= per_cell).select("cell")
        left = materialize(left.join(filled, "cell", "left_anti").join(chosen.select("quad_id"), "quad_id", "left_anti"), "index-left")
        discard(ask)
        before, n = n, chosen.count()
        if left.isEmpty() or n == before and limit >= loosen:
            return chosen
        if n == before:
            limit += 1


def tangent_steps() -> tuple[list[dict[str, str]], dict[str, str], list[dict[str, str]]]:
    """Code coordinates (u, v) of star p over stars l and r on the tangent plane at their midpoint m, column by column.

    First the plane's directions, then the places of l and r, last those of p and its code.
    """
    place = lambda s: {
        f"{s}_e": f"({s}x * te_x + {s}y * te_y) / ({s}x * mx + {s}y * my + {s}z * mz)",
        f"{s}_n": f"({s}x * tn_x + {s}y * tn_y + {s}z * tn_z) / ({s}x * mx + {s}y * my + {s}z * mz)",
    }
    u, v = pixel_code("l_e", "l_n", "r_e", "r_n", "p_e", "p_n")
    east = {"te_x": "-my / sqrt(mx * mx + my * my)", "te_y": "mx / sqrt(mx * mx + my * my)"}
    north = {"tn_x": "-mz * te_y", "tn_y": "mz * te_x", "tn_z": "mx * te_y - my * te_x"}
    return [east, north], place("l") | place("r"), [place("p"), {"u": u, "v": v}]


def build_index(catalog: DataFrame, id_col: str, ra: str, dec: str, sort_col: str, preset: int | tuple[float, float], per_cell: int = 10, quads_per_cell: int = 8, max_uses: int = 8, dedup_arcsec: float = 0.0, nside: int | None = None, loosen: int = 20) -> Index:
    """Stars and features of one scale range (a preset number, or edges in arc minutes)."""
    low, high = preset_scales(preset) if isinstance(preset, int) else preset
    n = nside or healpix.nside_of(low)
    stars = star_table(catalog, id_col, ra, dec, n)
    top = uniformize_top(stars, "cell", [F.col(sort_col).asc(), F.col("id").asc()], per_cell)
    if dedup_arcsec:
        kept = uniformize_dedup(stars, "id", sort_col, "cell", per_cell, math.radians(dedup_arcsec / 3600))
        top = stars.join(kept, "id")
    top = materialize(top.withColumn("rank", F.struct("sweep", F.col(sort_col), "id")), "index-stars")
    return Index(top.drop("rank"), materialize(cell_quads(top, n, low, high, quads_per_cell, max_uses, loosen), "index-quads"), low, high)


def _cells_of_tiles(tiles: DataFrame, nside: int, fine: int, margin_deg: float, gap: float) -> DataFrame:
    """``(fine, tile)``: the fine cells that lie in a tile or may hold a point within the margin of it."""
    inner, outer = healpix.cell_radius(fine), healpix.cell_radius(nside)
    reach = inner + margin_deg + gap

    def run(batches):
        every = np.arange(12 * fine * fine)
        centre = healpix.points_of(every, fine)
        home = healpix.cells_of(centre, nside)
        t = np.tile(np.linspace(0, 1, EDGE_STEPS + 1), 4)
        side = np.repeat(np.arange(4), EDGE_STEPS + 1)
        for batch in batches:
            for k in batch["id"]:
                middle = healpix.points_of(np.array([k]), nside)[0]
                some = every[centre @ middle >= math.cos(math.radians(min(180.0, outer + reach)))]
                edge = _edge_points(np.full(len(t), k), side, t, nside)
                near = (centre[some] @ edge.T).max(1) >= math.cos(math.radians(min(180.0, reach)))
                yield pd.DataFrame({"fine": some[near | (home[some] == k)], "tile": int(k)})

    return tiles.mapInPandas(run, "fine long, tile long")


def _edge_gap(nside: int) -> float:
    """Degrees between neighbouring samples of a tile's edge at most, over the whole grid, a thousand tiles at a time."""
    t = np.linspace(0, 1, EDGE_STEPS + 1)
    widest = 1.0
    for lo in range(0, 12 * nside * nside, 1000):
        tiles = np.arange(lo, min(lo + 1000, 12 * nside * nside))
        for side in range(4):
            ends = _edge_points(np.repeat(tiles, len(t)), np.full(len(tiles) * len(t), side), np.tile(t, len(tiles)), nside).reshape(len(tiles), len(t), 3)
            widest = min(widest, float((ends[:, 1:] * ends[:, :-1]).sum(-1).min()))
    return math.degrees(math.acos(max(-1.0, widest)))


def tiles_with_margin(stars: DataFrame, nside: int, margin_deg: float, only: Sequence[int] | None = None) -> DataFrame:
    """Every star once per tile that holds it or lies within the margin; ``tile`` and ``own``. ``only`` names the tiles wanted.

    The fine cells of the tiles are found by tasks, and broadcast only up to BROADCAST_CELLS rows. Samples of a
    tile's edge, with their spacing added to the reach, only say which stars to test; those are tested against
    the nearest point of the edge itself. The margin counts in, as far as rounding (about 1e-7 degrees) lets it.
    """
    spark, grid = stars.sparkSession, 12 * nside * nside
    if only is not None and not all(0 <= k < grid for k in only):
        raise ValueError(f"tiles are numbered from 0 to {grid - 1}")
    fine, gap = 4 * nside, _edge_gap(nside)
    tiles = spark.range(grid)
    if only is not None:
        tiles = tiles.where(F.col("id").isin(sorted(set(only))))
    lookup = _cells_of_tiles(tiles, nside, fine, margin_deg, gap)
    if lookup.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        lookup = F.broadcast(lookup)
    s = healpix.with_cell(healpix.with_cell(stars, fine, out="fine"), nside, out="home")
    s = s.join(lookup, "fine")

    @F.pandas_udf("double")
    def away(x: pd.Series, y: pd.Series, z: pd.Series, tile: pd.Series) -> pd.Series:
        return pd.Series(_degrees_to_edge(np.column_stack([x, y, z]).astype(float), tile.to_numpy(), nside, margin_deg + gap))

    s = s.withColumn("own", F.col("home") == F.col("tile")).withColumn("away", away("x", "y", "z", "tile"))
    return s.where(F.col("own") | (F.col("away") <= margin_deg + 1e-7)).drop("fine", "home", "away")


def owned_by_tile(stars: DataFrame, tile: int, nside: int, margin_deg: float = 0.0) -> DataFrame:
    """The stars of one tile, and those within ``margin_deg`` of it; ``own`` tells them apart.

    Without a margin this is a filter on the cell. Stars with a null coordinate are in no tile.
    """
    if margin_deg > 0:
        return tiles_with_margin(stars, nside, margin_deg, [tile]).drop("tile")
    return healpix.with_cell(stars, nside, out="home").where(F.col("home") == tile).drop("home").withColumn("own", F.lit(True))


def _edge_points(tile: np.ndarray, side: np.ndarray, t: np.ndarray, nside: int) -> np.ndarray:
    """Points at ``t`` of [0, 1] on one of the four sides of tiles."""
    dx = np.choose(side, (t, t, 0 * t, 0 * t + 1))
    dy = np.choose(side, (0 * t, 0 * t + 1, t, t))
    return healpix.points_of(tile, nside, dx, dy)


def _degrees_to_edge(p: np.ndarray, tile: np.ndarray, nside: int, reach_deg: float) -> np.ndarray:
    """Degrees from points to the edges of their tiles; infinite where no sample of the edge is within ``reach_deg``.

    Around every sample that is nearer than its neighbours the distance is minimised by ternary search.
    """
    best = np.full(len(p), np.inf)
    angle = lambda q, e: np.degrees(2 * np.arcsin(np.clip(np.linalg.norm(q - e, axis=1) / 2, 0, 1)))
    t = np.linspace(0, 1, EDGE_STEPS + 1)
    for side in range(4):
        a = np.stack([angle(p, _edge_points(tile, np.full(len(p), side), np.full(len(p), v), nside)) for v in t], axis=1)
        wide = np.pad(a, ((0, 0), (1, 1)), constant_values=np.inf)
        row, at = np.nonzero((a <= wide[:, :-2]) & (a <= wide[:, 2:]) & (a <= reach_deg))
        low, high = np.maximum(t[at] - 1 / EDGE_STEPS, 0), np.minimum(t[at] + 1 / EDGE_STEPS, 1)
        q, k, sides = p[row], tile[row], np.full(len(row), side)
        for _ in range(60):
            one, two = low + (high - low) / 3, high - (high - low) / 3
            left = angle(q, _edge_points(k, sides, one, nside)) <= angle(q, _edge_points(k, sides, two, nside))
            low, high = np.where(left, low, one), np.where(left, two, high)
        np.minimum.at(best, row, np.minimum(a[row, at], angle(q, _edge_points(k, sides, (low + high) / 2, nside))))
    return best


def indexes_for(indexes: DataFrame, scales: tuple[float, float], ra: float | None = None, dec: float | None = None, radius_deg: float = 0.0) -> DataFrame:
    """Index rows whose scales meet the wanted ones and whose tile centre is near enough (healpix -1: all sky)."""
    from skyweft.plans.solve import scale_overlap

    out = indexes.where(scale_overlap("scale_lower", "scale_upper", scales))
    if ra is None:
        return out
    x, y, z = (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    dot = f"tile_x * {num(x)} + tile_y * {num(y)} + tile_z * {num(z)}"
    return out.where(F.expr(f"healpix = -1 OR degrees(acos(least({num(1)}, {dot}))) <= {num(radius_deg)} + tile_radius"))
