"""Brightness-uniform thinning of catalogues, and the list orders built on ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweft.operators.spatial import radius_join
from skyweft.operators.table import _unused
from skyweft.session import discard, materialize


def uniformize_top(stars: DataFrame, cell: str, order: list[Column], per_cell: int, min_cut: Column | None = None) -> DataFrame:
    """The first ``per_cell`` stars of each cell; ``sweep`` is a star's 0-based place in its cell."""
    if min_cut is not None:
        stars = stars.where(min_cut)
    return stars.withColumn("sweep", F.row_number().over(Window.partitionBy(cell).orderBy(*order)) - 1).where(F.col("sweep") < per_cell)


def uniformize_dedup(stars: DataFrame, id_col: str, rank_col: str, cell: str, per_cell: int, radius: float, coords=("x", "y", "z"), max_rounds: int | None = None) -> DataFrame:
    """Thinning with a minimum distance: ``(id, sweep)`` of the stars kept.

    In rank order a star is kept unless its cell is full or a kept star lies within ``radius``. A round looks at the first open
    stars of every cell only and keeps those that no earlier open star lies near and whose cell can't fill before them; then all
    open stars near a kept one and those of full cells go. So decisions equal those of a walk in order, and near pairs are
    made for the stars looked at and kept, never for all. The first open star is always kept, so rounds go on until no star is
    open; a chain of near stars takes about one round for two links. With ``max_rounds`` it raises where stars are open after so many.
    """
    place = [f"p{i}" for i in range(len(coords))]
    left = stars.select(F.col(id_col).alias("id"), F.col(rank_col).alias("rank"), F.col(cell).alias("cell"), *[F.col(c).cast("double").alias(p) for c, p in zip(coords, place, strict=True)])
    left = materialize(left, "uniformize")
    if not left.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("ids have to be unique")
    kept, rounds = left.where("false").select("id", "rank", "cell"), 0
    order = Window.partitionBy("cell").orderBy("rank", "id")
    earlier = "r_rank < l_rank OR (r_rank = l_rank AND r_id < l_id)"
    while not left.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"{left.count()} stars are open after {max_rounds} rounds")
        rounds += 1
        full = kept.groupBy(F.col("cell").alias("of")).agg(F.count(F.lit(1)).alias("n"))
        first = left.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= max(16, 4 * per_cell))
        first = materialize(first.join(full, F.col("cell").eqNullSafe(F.col("of")), "left").select(*left.columns, "turn", F.coalesce("n", F.lit(0)).alias("n")), "uniformize-first")
        waits = radius_join(first, left, radius, place, not_self=True, left_keep=["rank"], right_keep=["rank"]).where(earlier).select(F.col("l_id").alias("id")).distinct()
        new = materialize(first.where(F.col("n") + F.col("turn") <= per_cell).join(waits, "id", "left_anti").select(*left.columns), "uniformize-kept")
        kept = kept.unionByName(new.select("id", "rank", "cell"))
        near = radius_join(new, left, radius, place, not_self=True, left_keep=["rank"], right_keep=["rank"]).where("l_rank < r_rank OR (l_rank = r_rank AND l_id < r_id)").select(F.col("r_id").alias("id"))
        gone = near.unionByName(new.select("id")).distinct()
        full = kept.groupBy(F.col("cell").alias("of")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= per_cell).select("of")
        rest = left.join(gone.hint("merge"), "id", "left_anti").join(full, F.col("cell").eqNullSafe(F.col("of")), "left_anti")
        rest = materialize(rest if per_cell > 0 else rest.where("false"), "uniformize")
        discard(left)
        left = rest
    return kept.select("id", (F.row_number().over(Window.partitionBy("cell").orderBy("rank", "id")) - 1).alias("sweep"))


def interleave(df: DataFrame, keys: list[str], first: list[Column], second: list[Column], out: str = "place") -> DataFrame:
    """Alternates two orders, each row at its first occurrence: place by least(2 r1, 2 r2 + 1) of the 0-based ranks."""
    w = lambda cols: F.row_number().over(Window.partitionBy(*keys).orderBy(*cols)) - 1
    a, b, k = (_unused(df, n) for n in ("first_rank", "second_rank", "turn"))
    both = df.withColumns({a: w(first), b: w(second)}).withColumn(k, F.least(2 * F.col(a), 2 * F.col(b) + 1))
    return both.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(k)) - 1).drop(a, b, k)


def round_robin(df: DataFrame, keys: list[str], cell: str, order: list[Column], out: str = "place") -> DataFrame:
    """Interleaves the cells of a field: all firsts of the cells in order, then all seconds, and so on."""
    r = _unused(df, "turn")
    in_cell = df.withColumn(r, F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)))
    return in_cell.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(r, *order)) - 1).drop(r)
