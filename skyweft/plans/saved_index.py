"""Indexes as folders: written, listed by their metadata alone, opened together, merged, flattened.

A folder holds ``meta`` (one row), ``stars`` and ``quads`` as Parquet. Indexes over the same stars may
share them: the metadata names the folder of the stars.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweft.operators.spatial import dealt_join
from skyweft.plans.build_index import Index, cell_quads
from skyweft.session import shuffle_partitions

#: Tasks that write one tile.
TILE_PARTS = 16

META = "index_id int, healpix int, nside int, scale_lower double, scale_upper double, stars_at string, n_stars long, n_quads long"


def save_index(index: Index, folder: str, index_id: int, healpix: int = -1, nside: int = 0, stars_at: str | None = None) -> None:
    """Writes an index; with ``stars_at`` the stars are those of another index's folder and are not written again."""
    spark = index.quads.sparkSession
    if stars_at is None:
        index.stars.write.parquet(f"{folder}/stars")
    index.quads.write.parquet(f"{folder}/quads")
    at = stars_at or folder
    n_stars, n_quads = spark.read.parquet(f"{at}/stars").count(), spark.read.parquet(f"{folder}/quads").count()
    row = (index_id, healpix, nside, float(index.low_arcmin), float(index.high_arcmin), at, n_stars, n_quads)
    spark.createDataFrame([row], META).coalesce(1).write.parquet(f"{folder}/meta")  # last: an index without it is not whole


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """The metadata of all whole indexes below a folder, with their ``folder``; nothing else is read."""
    meta = spark.read.schema(META).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(f"{root}/*/meta")
    return meta.select("*", F.regexp_replace(F.col("_metadata.file_path"), "/meta/[^/]*$", "").alias("folder"))


def load_index(spark: SparkSession, folder: str) -> Index:
    meta = spark.read.schema(META).parquet(f"{folder}/meta").first()
    return Index(spark.read.parquet(f"{meta['stars_at']}/stars"), spark.read.parquet(f"{folder}/quads"), meta["scale_lower"], meta["scale_upper"])


def open_indexes(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(stars, quads)`` of several indexes together, each row with its ``folder``; shared stars are read once."""
    metas = {f: spark.read.schema(META).parquet(f"{f}/meta").first() for f in folders}
    star_folders = dict.fromkeys(m["stars_at"] for m in metas.values())
    tagged = lambda at, what, tag: spark.read.parquet(f"{at}/{what}").withColumn("folder", F.lit(tag))
    stars = reduce(DataFrame.unionByName, [tagged(at, "stars", at) for at in star_folders])
    quads = reduce(DataFrame.unionByName, [tagged(f, "quads", f) for f in folders])
    return stars, quads


def merge_indexes(parts: Sequence[Index]) -> Index:
    """Parts (tiles) as one index: a star or feature that several hold (their margins) counts once."""
    both = lambda dfs, key: reduce(DataFrame.unionByName, dfs).dropDuplicates([key])
    return Index(both([p.stars for p in parts], "id"), both([p.quads for p in parts], "quad_id"), min(p.low_arcmin for p in parts), max(p.high_arcmin for p in parts))


def flat_table(index: Index) -> DataFrame:
    """One row a feature with the positions of its stars, in the order a, b, c, d."""
    s = index.stars.select(F.col("id").alias("star"), "ra", "dec")
    member = index.quads.select("quad_id", F.posexplode(F.array("a", "b", "c", "d")).alias("i", "star")).hint("merge").join(s.hint("merge"), "star")
    member = member.repartition(shuffle_partitions(s.sparkSession), "quad_id")  # rows grow where they are grouped: as many tasks as the session has
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{'abcd'[i]}")
    return member.groupBy("quad_id").agg(*[pick(c, i) for i in range(4) for c in ("star", "ra", "dec")])


def share_stars(index: Index, stars: DataFrame, nside: int, low_arcmin: float, high_arcmin: float, per_cell: int = 8, max_uses: int = 8) -> Index:
    """An index of other scales over the stars of one that is there; ``stars`` are its stars with their ``rank``."""
    return Index(index.stars, cell_quads(stars, nside, low_arcmin, high_arcmin, per_cell, max_uses), low_arcmin, high_arcmin)


def write_tiles(rows: DataFrame, path: str, tile_col: str = "tile") -> None:
    """One folder of files a tile. Rows carry where they come from (``backref_file``, ``backref_index``), as a read with ``provenance`` gives it."""
    missing = {"backref_file", "backref_index"} - set(rows.columns)
    if missing:
        raise ValueError(f"rows without {sorted(missing)}")
    part = F.pmod(F.col("backref_index"), F.lit(TILE_PARTS))  # a tile is the work of several tasks, each writing a file of it
    rows.repartition(shuffle_partitions(rows.sparkSession), F.col(tile_col), part).write.partitionBy(tile_col).parquet(path)


def copied_rows(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` (read with ``provenance``) by a list of their files and numbers: ``wanted`` has backref_file, backref_index and place.

    A row that is listed twice comes twice; ``place`` keeps the order of the list. Pairs that are not there give nothing.
    """
    return dealt_join(wanted.select("backref_file", "backref_index", "place"), source, ["backref_file", "backref_index"])


def occupied_cells(stars: DataFrame, nside: int) -> DataFrame:
    """Sorted list of the cells that hold a star."""
    from skyweft.functions import healpix

    return healpix.with_cell(stars, nside).select("cell").distinct().orderBy("cell")
