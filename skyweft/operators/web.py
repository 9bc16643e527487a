"""Queries of an image-calibration service: tags, users, jobs, places, paging.

Tables: images(image_id, user_id, public), jobs(job_id, image_id, status, end_time, calibration_id),
calibrations(calibration_id, x, y, z, r, nside, cell), tags(image_id, tag), users(user_id, anonymous).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.functions import healpix, sky


def images_by_tag(images: DataFrame, tags: DataFrame, text: str, exact: bool = True) -> DataFrame:
    """Images with a tag equal to ``text`` in any case, or holding it."""
    hit = F.lower("tag") == text.lower() if exact else F.lower("tag").contains(text.lower())
    return images.join(tags.where(hit).select("image_id").distinct(), "image_id", "left_semi")


def users_by_name(users: DataFrame, text: str, col: str = "name") -> DataFrame:
    return users.where(F.lower(col).contains(text.lower()))


def popular_tags(tags: DataFrame, n: int = 35) -> DataFrame:
    """The most used tags, equal counts by name."""
    return tags.groupBy("tag").agg(F.countDistinct("image_id").alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def autocomplete(tags: DataFrame, prefix: str, n: int = 8) -> DataFrame:
    return tags.where(F.lower("tag").startswith(prefix.lower())).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(n)


def unstarted_images(images: DataFrame, jobs: DataFrame) -> DataFrame:
    """Images without any job."""
    return images.join(jobs.select("image_id"), "image_id", "left_anti")


def job_counts(images: DataFrame, jobs: DataFrame) -> DataFrame:
    counts = jobs.groupBy("image_id").agg(F.count(F.lit(1)).alias("jobs"))
    return images.select("image_id").join(counts, "image_id", "left").select("image_id", F.coalesce("jobs", F.lit(0)).cast("long").alias("jobs"))


def best_jobs(jobs: DataFrame) -> DataFrame:
    """One job per image: a solved one if there is any, of these the latest end, then the largest id."""
    best = F.max(F.struct(F.col("calibration_id").isNotNull().alias("solved"), "end_time", "job_id")).alias("b")
    return jobs.groupBy("image_id").agg(best).select("image_id", F.col("b.job_id").alias("job_id"), F.col("b.solved").alias("solved"))


def visible_images(images: DataFrame, users: DataFrame, best: DataFrame, viewer: int | None = None) -> DataFrame:
    """Public images or the viewer's own, of known users or, for anonymous ones, only if solved."""
    whole = images.join(users, "user_id").join(best.select("image_id", "solved"), "image_id", "left")
    own = F.col("user_id") == viewer if viewer is not None else F.lit(False)
    return whole.where((F.col("public") | own) & (~F.col("anonymous") | F.coalesce("solved", F.lit(False)))).select(*images.columns)


def near_place(calibrations: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Calibrations of a radius up to ``radius_deg`` whose centre lies within it, by angle."""
    x, y, z = (math.cos(math.radians(dec)) * math.cos(math.radians(ra)), math.cos(math.radians(dec)) * math.sin(math.radians(ra)), math.sin(math.radians(dec)))
    d2 = f"(x - {sky.num(x)}) * (x - {sky.num(x)}) + (y - {sky.num(y)}) * (y - {sky.num(y)}) + (z - {sky.num(z)}) * (z - {sky.num(z)})"
    return calibrations.where(F.expr(f"{d2} < {sky.num(sky.chord2_of_deg(radius_deg))}") & (F.col("r") <= radius_deg))


def nearby_images(places: DataFrame, cell: int, nside: int) -> DataFrame:
    """Images in the same cell or a neighbouring one, in the cell's parent, or in a child of either kind."""
    a, b = healpix.neighbour_pairs(nside)
    near = [cell, *(int(v) for u, v in zip(a, b, strict=True) if u == cell)]
    centre = lambda c, n: healpix.points_of([c], n)
    parent = int(healpix.cells_of(centre(cell, nside), nside // 2)[0]) if nside > 1 else -1
    import numpy as np

    kids = [int(c) for n in near for c in np.unique(healpix.cells_of(np.concatenate([healpix.points_of([n], nside, dx, dy) for dx in (0.25, 0.75) for dy in (0.25, 0.75)]), 2 * nside))]
    same = (F.col("nside") == nside) & F.col("cell").isin(near)
    return places.where(same | ((F.col("nside") * 2 == nside) & (F.col("cell") == parent)) | ((F.col("nside") == 2 * nside) & F.col("cell").isin(kids)))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` from 1 on."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def job_info(jobs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(job_id, info)``: JSON of a job's status and its image's tags."""
    own = tags.groupBy("image_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return jobs.join(own, "image_id", "left").select("job_id", F.to_json(F.struct("status", "image_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))).alias("info"))
