"""Reference catalogues: line layouts, quality cuts, flags, name lookups, what lies in a field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweft.functions import sky, wcs
from skyweft.sources.packed import read_records
from skyweft.sources.text import read_fixed_width

#: Tycho-2 main catalogue lines: name -> (first column, length, type); fixed by the catalogue.
TYCHO2 = {
    "tyc1": (1, 4, "int"), "tyc2": (6, 5, "int"), "tyc3": (12, 1, "int"), "mean_ra": (16, 12, "double"), "mean_dec": (29, 12, "double"),
    "pm_ra": (42, 7, "double"), "pm_dec": (50, 7, "double"), "mag_bt": (111, 6, "double"), "mag_vt": (124, 6, "double"), "ra": (153, 12, "double"), "dec": (166, 12, "double"),
}
#: Columns of the 2MASS point-source text, in order, as far as they are read here; fields are split at '|'.
TWOMASS = {0: ("ra", "double"), 1: ("dec", "double"), 5: ("designation", "string"), 6: ("j_mag", "double"), 10: ("h_mag", "double"), 14: ("k_mag", "double"), 18: ("quality", "string"), 19: ("read_flag", "string"), 20: ("blend", "string"), 21: ("cc", "string")}
#: Packed record of the NOMAD catalogue begins with these fields, as struct codes (fixed by the catalogue).
NOMAD_RECORD = 88
NOMAD_PACKED = [("ra_mas", "I"), ("spd_mas", "I"), ("sigma_ra", "I"), ("sigma_spd", "I"), ("pm_ra", "i"), ("pm_spd", "i"), ("sigma_pm_ra", "I"), ("sigma_pm_spd", "I"), ("epoch_ra", "I"), ("epoch_spd", "I"), ("mag_b", "h"), ("mag_v", "h"), ("mag_r", "h"), ("mag_j", "h"), ("mag_h", "h"), ("mag_k", "h")]


def read_tycho2(spark: SparkSession, path: str) -> DataFrame:
    """Tycho-2 lines; a missing mean position is replaced by the observed one."""
    t = read_fixed_width(spark, path, TYCHO2)
    return t.withColumns({"ra_best": F.coalesce("mean_ra", "ra"), "dec_best": F.coalesce("mean_dec", "dec")})


def read_2mass(spark: SparkSession, path: str) -> DataFrame:
    """2MASS point sources; the text for null becomes null."""
    v = F.split("value", r"\|")
    field = lambda i: F.when(F.trim(v[i]) != r"\N", F.trim(v[i]))
    return spark.read.text(path).select(*[field(i).try_cast(t).alias(n) for i, (n, t) in TWOMASS.items()])


def read_nomad(spark: SparkSession, path: str, records: int = 1_000_000) -> DataFrame:
    """Positions and magnitudes of NOMAD files, a range of records a task."""
    return nomad_positions(read_records(spark, path, NOMAD_PACKED, NOMAD_RECORD, records))


def nomad_positions(packed: DataFrame) -> DataFrame:
    """Degrees and magnitudes of packed NOMAD records; 30 mag and more means none."""
    mag = lambda c: F.when(F.col(c) < 30000, F.col(c) / 1000.0).alias(c)
    return packed.select((F.col("ra_mas") / 3.6e6).alias("ra"), (F.col("spd_mas") / 3.6e6 - 90.0).alias("dec"), *[mag(c) for c in ("mag_b", "mag_v", "mag_r", "mag_j", "mag_h", "mag_k")])


def quality_cut(stars: DataFrame, quality: str, contamination: str, keep: Sequence[str]) -> DataFrame:
    """Rows of known quality and without contamination, three columns or so of them."""
    return stars.where((F.col(quality) != 0) & (F.col(contamination) == 0)).select(*keep)


def diffraction_cut(stars: DataFrame, spike: str, detections: str, least: int = 3) -> DataFrame:
    """Rows that are no diffraction spikes and were seen on enough plates."""
    return stars.where(~F.col(spike) & (F.col(detections) >= least))


def mean_magnitude(mags: str) -> Column:
    """Mean over the known (positive) magnitudes of an array; null where there are none."""
    known = F.filter(F.col(mags), lambda m: m.isNotNull() & (m > 0))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, m: s + m.cast("double")) / F.size(known))


def box_query(stars: DataFrame, ra: tuple[float, float], dec: tuple[float, float], mag: str | None = None, faintest: float | None = None) -> DataFrame:
    """Stars in an RA / Dec box, across RA 0 if the first RA is the larger one."""
    r = F.col("ra").between(*ra) if ra[0] <= ra[1] else (F.col("ra") >= ra[0]) | (F.col("ra") <= ra[1])
    out = stars.where(r & F.col("dec").between(*dec))
    return out if mag is None else out.where(F.col(mag) <= faintest)


def accurate_positions(rough: DataFrame, accurate: DataFrame, key: Sequence[str], cols: Sequence[str] = ("ra", "dec")) -> DataFrame:
    """Rows of ``rough`` with the accurate position where there is one."""
    better = accurate.select(*key, *[F.col(c).alias(f"__{c}") for c in cols])
    out = rough.join(better, list(key), "left")
    return out.select(*[F.coalesce(f"__{c}", c).alias(c) if c in cols else F.col(c) for c in rough.columns])


def with_names(objects: DataFrame, names: DataFrame, key: Sequence[str], name: str = "name") -> DataFrame:
    """Each object with the sorted list of its names; an empty list where it has none."""
    lists = names.groupBy(*key).agg(F.array_sort(F.collect_set(name)).alias("names"))
    return objects.join(lists, list(key), "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def cross_identify(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b, list(key))


def in_footprint(objects: DataFrame, w: wcs.Tan, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Objects inside an image, with pixels px and py."""
    px, py = wcs.sky_to_pixel(w, x, y, z)
    return objects.withColumns({"px": F.expr(px), "py": F.expr(py)}).where(wcs.in_image(w, "px", "py"))


def annotations(catalogs: dict[str, tuple[DataFrame, float | None]], w: wcs.Tan, radius_deg: float, brightest: int | None = None) -> DataFrame:
    """Objects of several catalogues (name, x, y, z, mag) in an image.

    A catalogue with a limit only counts in fields of a smaller radius than that; ``brightest`` keeps so many named ones.
    """
    out = None
    for kind, (cat, limit) in catalogs.items():
        if limit is None or radius_deg < limit:
            part = in_footprint(cat.select("name", "x", "y", "z", "mag"), w).select(F.lit(kind).alias("kind"), "name", "px", "py", "mag")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no catalogue is used for fields of this size")
    return out if brightest is None else out.where("name <> ''").orderBy("mag", "name").limit(brightest)


def within_annulus(stars: DataFrame, ra: float, dec: float, inner_deg: float, outer_deg: float) -> DataFrame:
    """Stars between two angles from a place, both ends in."""
    from skyweft.operators.spatial import cone_search

    return cone_search(stars, ra, dec, outer_deg).where(F.col("dist_deg") >= inner_deg)


def numbers_within(stars: DataFrame, position: str, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """``(number, ra, dec, dist_deg)`` of stars (x, y, z) within a cone, for catalogues whose numbers are places in the file.

    ``position`` counts from zero, as ``sources.fits.provenance`` gives it; numbers count from one.
    """
    from skyweft.operators.spatial import cone_search

    got = cone_search(stars, ra, dec, radius_deg)
    return got.select((F.col(position) + 1).cast("long").alias("number"), F.expr(sky.ra_of("x", "y")).alias("ra"), F.expr(sky.dec_of("z")).alias("dec"), "dist_deg")


def bounding_box(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))


def mean_direction(stars: DataFrame) -> DataFrame:
    """Mean place (ra, dec) of unit vectors."""
    m = stars.agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    norm = "sqrt(x * x + y * y + z * z)"
    return m.select(F.expr(sky.ra_of("x", "y")).alias("ra"), F.expr(sky.dec_of(f"z / {norm}")).alias("dec"))
