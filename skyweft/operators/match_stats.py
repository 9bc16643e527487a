"""Statistics over matches and pairs: shifts by votes, residuals, certificates, footprints, feature sizes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.functions import sky
from skyweft.operators.greedy import near_in_group, walk_dropped
from skyweft.operators.spatial import radius_join
from skyweft.operators.table import bin_of, histogram


def shift_by_votes(left: DataFrame, right: DataFrame, reach: float, bin_size: float, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """``(dx, dy, votes)``: the offset right - left that most pairs within ``reach`` agree on, by bin centre.

    Pairs come from the bucketed join, votes are counted before the shuffle; ties go to the smallest bin.
    """
    pairs = radius_join(left, right, reach * math.sqrt(2), ("x", "y"), left_id, right_id, places=True)
    d = pairs.selectExpr("r0 - l0 AS dx", "r1 - l1 AS dy").where((F.abs("dx") <= reach) & (F.abs("dy") <= reach))
    bins = math.ceil(2 * reach / bin_size)
    votes = d.groupBy(F.expr(bin_of("dx", -reach, bin_size, bins)).alias("bx"), F.expr(bin_of("dy", -reach, bin_size, bins)).alias("by")).agg(F.count(F.lit(1)).alias("votes"))
    top = votes.orderBy(F.desc("votes"), "bx", "by").limit(1)
    return top.select((F.col("bx") * bin_size - reach + bin_size / 2).alias("dx"), (F.col("by") * bin_size - reach + bin_size / 2).alias("dy"), "votes")


def residuals(pairs: DataFrame, dist2: str, weight: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """Mean distance, root mean square and weighted root mean square of pairs."""
    w = F.col(weight) if weight else F.lit(1.0)
    return pairs.groupBy(*(keys or [])).agg(F.avg(F.sqrt(dist2)).alias("mean"), F.sqrt(F.avg(dist2)).alias("rms"), F.sqrt(F.sum(w * F.col(dist2)) / F.sum(w)).alias("wrms"))


def match_labels(labels: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Matches, conflicts and distractors per match: labels >= 0, -2 and -1."""
    return labels.groupBy(key).agg(F.count_if(F.col(label) >= 0).alias("n_match"), F.count_if(F.col(label) == -2).alias("n_conflict"), F.count_if(F.col(label) == -1).alias("n_distract"))


def certify(matches: DataFrame, truth: DataFrame, key: str, first: int) -> DataFrame:
    """Matches (x, y, z, r2) with ``correct``: all of the key's first true places lie within 1.2 r2 of the centre; null without truth."""
    t = truth.where(F.col("rank") < first).select(key, F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))
    m = matches.withColumn("__m", F.xxhash64(*matches.columns))
    inside = F.expr("(x - tx) * (x - tx) + (y - ty) * (y - ty) + (z - tz) * (z - tz) <= 1.2 * r2")
    verdict = m.join(t, key).groupBy("__m").agg(F.bool_and(inside).alias("correct"))
    return m.join(verdict, "__m", "left").drop("__m")


def merge_solved(flags: DataFrame, key: str = "field", solved: str = "solved") -> DataFrame:
    """A field is solved if any run solved it."""
    return flags.groupBy(key).agg(F.max(solved).alias(solved))


def merge_by_field(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Matches of several runs in lists by field."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rest = [c for c in out.columns if c not in keys]
    return out.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("matches"))


def unique_files(files: DataFrame, content: str = "content") -> DataFrame:
    """Files by the digest of their content, one path each."""
    return files.groupBy(F.sha1(content).alias("file_hash")).agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def separation_histogram(points: DataFrame, radius: float, bin_size: float, coords=("x", "y", "z"), id_col: str = "id") -> DataFrame:
    """Counts of pair distances below ``radius``, each pair once."""
    pairs = radius_join(points, points, radius, coords, id_col, id_col, not_self=True).where("l_id < r_id").select(F.sqrt("dist2").alias("d"))
    return histogram(pairs, "d", 0.0, bin_size, math.ceil(radius / bin_size))


def feature_sizes(quads: DataFrame, stars: DataFrame) -> DataFrame:
    """``(quad_id, arcmin, ra, dec, faintest)``: the angle between A and B, their midpoint, the faintest member's magnitude."""
    s = stars.select(F.col("id").alias("sid"), "x", "y", "z", "mag")
    member = quads.select("quad_id", F.posexplode(F.array("a", "b", "c", "d")).alias("i", "sid")).join(s, "sid")
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}")
    g = member.groupBy("quad_id").agg(*[pick(c, i) for c in "xyz" for i in (0, 1)], F.max("mag").alias("faintest"))
    d2 = "pow(x0 - x1, 2) + pow(y0 - y1, 2) + pow(z0 - z1, 2)"
    norm = "sqrt(pow(x0 + x1, 2) + pow(y0 + y1, 2) + pow(z0 + z1, 2))"
    return g.select("quad_id", (F.expr(sky.deg_of_chord2(f"({d2})")) * 60).alias("arcmin"), F.expr(sky.ra_of("(x0 + x1)", "(y0 + y1)")).alias("ra"), F.expr(sky.dec_of(f"(z0 + z1) / {norm}")).alias("dec"), "faintest")


def overlapping_footprints(footprints: DataFrame, id_col: str = "id") -> DataFrame:
    """Pairs (a, b), a < b, of circular footprints (x, y, z, r in degrees) that meet.

    Footprints are joined within the sum of the largest radius and the own one; the exact test follows.
    """
    top = footprints.agg(F.max("r").alias("r")).first()["r"]
    if top is None:
        return footprints.select(F.col(id_col).alias("a"), F.col(id_col).alias("b")).where("false")
    both = radius_join(footprints, footprints, math.sqrt(sky.chord2_of_deg(min(180.0, 2 * top))), ("x", "y", "z"), id_col, id_col, not_self=True, left_keep=["r"], right_keep=["r"]).where("l_id < r_id")
    return both.where(F.expr(f"{sky.deg_of_chord2('dist2')} <= l_r + r_r")).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))


def free_stars(stars: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """Field stars that are not members of the match itself."""
    return stars.join(used.select(*keys).distinct(), keys, "left_anti")


def dedup_field_stars(stars: DataFrame, radius: float, field: str = "field", id_col: str = "id") -> DataFrame:
    """Field stars (x, y, rank) that no kept brighter one of the same field lies within ``radius`` of.

    Stars are taken by (rank, id); a star that was dropped drops no other. Stars of a field meet in cells of the
    radius, so that no field is taken as a whole. Stars without a position stay.
    """
    s = stars.select(F.col(field).alias("group"), F.col(id_col).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("rank").alias("turn"))
    gone = walk_dropped(near_in_group(s, ["group"], sky.num(radius), sky.num(radius**2)), ["group"])
    return stars.join(gone.select(F.col("group").alias(field), F.col("id").alias(id_col)).hint("merge"), [field, id_col], "left_anti")


def unique_solutions(matches: DataFrame, keys: list[str], odds: str) -> DataFrame:
    """One row of each solution found several times: that of the highest odds, ties by all other columns."""
    rest = [c for c in matches.columns if c not in keys]
    best = matches.groupBy(*keys).agg(F.max(F.struct(odds, *[c for c in rest if c != odds])).alias("m"))
    return best.select(*[F.col(c) if c in keys else F.col(f"m.{c}").alias(c) for c in matches.columns])


def feature_magnitudes(quads: DataFrame, stars: DataFrame, mag: str = "mag") -> DataFrame:
    """``(quad_id, brightest, faintest)`` of every feature's members."""
    s = stars.select(F.col("id").alias("sid"), F.col(mag).alias("m"))
    member = quads.select("quad_id", F.explode(F.array("a", "b", "c", "d")).alias("sid"))
    return member.join(s, "sid").groupBy("quad_id").agg(F.min("m").alias("brightest"), F.max("m").alias("faintest"))


def index_summary(stars: DataFrame, quads: DataFrame) -> DataFrame:
    """One row: numbers of stars, features and stars used, uses a star, and the stars of the fullest cell."""
    used = quads.select(F.explode(F.array("a", "b", "c", "d")).alias("star")).groupBy("star").agg(F.count(F.lit(1)).alias("uses"))
    u = used.agg(F.count(F.lit(1)).alias("n_used"), F.max("uses").alias("most_uses"), F.avg("uses").alias("mean_uses"))
    cells = stars.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    c = cells.agg(F.sum("n").alias("n_stars"), F.count(F.lit(1)).alias("n_cells"), F.max("n").alias("most_in_cell"))
    q = quads.agg(F.count(F.lit(1)).alias("n_quads"))
    return c.crossJoin(q).crossJoin(u)  # three tables of one row


def pixel_range(low_arcmin: str, high_arcmin: str, scale: tuple[float, float]) -> tuple[str, str]:
    """Sizes in pixels that features of an index can have in an image of so many arc seconds a pixel, as SQL text."""
    return f"({low_arcmin} * 60.0 / {sky.num(scale[1])})", f"({high_arcmin} * 60.0 / {sky.num(scale[0])})"


def guess_scale(header: DataFrame) -> DataFrame:
    """``(image, guess, low, high)``: arc seconds a pixel from the keywords of headers (image, name, value), 1% around each.

    Read are PIXSCALE and SCALE (arc seconds), CDELT1 (degrees), CD1_1 with CD1_2, CD2_1 and CD2_2 (degrees), and FOCALLEN
    (mm) with XPIXSZ (microns).
    """
    wanted = ["PIXSCALE", "SCALE", "CDELT1", "CD1_1", "CD1_2", "CD2_1", "CD2_2", "FOCALLEN", "XPIXSZ"]
    value = lambda k: F.max(F.when(F.upper("name") == k, F.expr("try_cast(value as double)"))).alias(k)
    h = header.where(F.upper("name").isin(wanted)).groupBy("image").agg(*map(value, wanted))
    det = "abs(CD1_1 * CD2_2 - coalesce(CD1_2, 0.0D) * coalesce(CD2_1, 0.0D))"
    g = h.select("image", F.explode(F.expr(f"array(PIXSCALE, SCALE, abs(CDELT1) * 3600, sqrt({det}) * 3600, XPIXSZ / FOCALLEN * {sky.num(math.degrees(1e-3) * 3600)})")).alias("guess"))
    return g.where("guess > 0").distinct().select("image", "guess", (F.col("guess") * 0.99).alias("low"), (F.col("guess") * 1.01).alias("high"))


def invalid_fields(stars: DataFrame, field: str = "field") -> DataFrame:
    """``(field, reason, n)``: stars of a field list that cannot be used: no position, no number in it, a repeated id."""
    bad = F.when(F.col("x").isNull() | F.col("y").isNull(), "no position").when(F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")), "not a number")
    places = stars.select(field, bad.alias("reason")).where("reason is not null")
    again = stars.groupBy(field, "id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(field, F.lit("repeated id").alias("reason"))
    return places.unionByName(again).groupBy(field, "reason").agg(F.count(F.lit(1)).alias("n"))
