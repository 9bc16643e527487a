"""Hints for jobs: what options, file headers and defaults say, resolved keyword by keyword."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sources of hints, the first that says something counts.
SOURCES = ("option", "header", "default")
#: Arc seconds a pixel of a scale given in other units, from the image's width in pixels (fixed by what the units mean).
UNITS = {"arcsecperpix": "{0}", "degwidth": "{0} * 3600 / width", "arcminwidth": "{0} * 60 / width", "focalmm": "2 * degrees(atan(36.0D / (2 * {0}))) * 3600 / width"}


def resolved(hints: DataFrame, keywords: Sequence[str], sources: Sequence[str] = SOURCES) -> DataFrame:
    """``(job, one column a keyword)`` from ``hints`` (job, source, keyword, value, and place): for each keyword the value of the first source that has one.

    Within a source the last ``place`` counts, as a repeated option replaces an earlier one; a null value says nothing. Keywords are taken in
    any case; what nobody says is null. Jobs are grouped once, so a job's hints may come from many files.
    """
    rank = F.coalesce(*[F.when(F.lower("source") == s, k) for k, s in enumerate(sources)])
    h = hints.where(F.col("value").isNotNull()).withColumn("rank", rank).where("rank IS NOT NULL")
    pick = lambda k: F.min(F.when(F.lower("keyword") == k.lower(), F.struct("rank", -F.col("place"), "value"))).alias(k)
    got = h.groupBy("job").agg(*map(pick, keywords))
    some = hints.select("job").distinct()
    return some.join(got, "job", "left").select("job", *[F.col(k)["value"].alias(k) for k in keywords])


def job_table(hints: DataFrame, engine: dict[str, float], sources: Sequence[str] = SOURCES) -> DataFrame:
    """What a job is to do: ``(job, width, height, scale_low, scale_high, ra, dec, radius, depth, parity, cpu_limit)``.

    Scales are in arc seconds a pixel; a job without them gets those of the engine's widest and narrowest image (``min_width``, ``max_width``
    in degrees). A scale's ends may come in either order. Numbers that do not parse say nothing. A job may only lower the engine's ``cpu_limit``; a position without a
    radius has the engine's ``radius``.
    """
    number = lambda k: F.expr(f"try_cast({k} as double)")
    j = resolved(hints, ("width", "height", "scale_low", "scale_high", "scale_units", "ra", "dec", "radius", "depth", "parity", "cpu_limit"), sources)
    j = j.withColumns({k: number(k) for k in ("width", "height", "scale_low", "scale_high", "ra", "dec", "radius", "depth", "cpu_limit")})
    in_units = lambda c: F.coalesce(*[F.when(F.lower(F.coalesce("scale_units", F.lit("degwidth"))) == u, F.expr(e.format(c))) for u, e in UNITS.items()])
    own = [in_units(c) for c in ("scale_low", "scale_high")]
    j = j.withColumns({"lo": F.least(*own), "hi": F.greatest(*own), "all_lo": F.lit(engine["min_width"] * 3600) / F.col("width"), "all_hi": F.lit(engine["max_width"] * 3600) / F.col("width")})
    limit = F.when(F.coalesce("cpu_limit", F.lit(0.0)) > 0, F.least("cpu_limit", F.lit(float(engine["cpu_limit"])))).otherwise(float(engine["cpu_limit"]))
    parity = F.when(F.lower("parity").isin("pos", "neg"), F.lower("parity")).otherwise("both")
    radius = F.when(F.col("ra").isNotNull() & F.col("dec").isNotNull(), F.coalesce("radius", F.lit(float(engine["radius"]))))
    return j.select("job", "width", "height", F.coalesce("lo", "all_lo").alias("scale_low"), F.coalesce("hi", "all_hi").alias("scale_high"), "ra", "dec", radius.alias("radius"), F.col("depth").cast("long").alias("depth"), parity.alias("parity"), limit.alias("cpu_limit"))
