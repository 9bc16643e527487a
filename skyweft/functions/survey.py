"""Pixels of drift-scan survey fields, in columns: polynomials along the row, a colour term, an affine map to great-circle coordinates.

A field's calibration stands in the columns CALIBRATION, a row each: ``a`` .. ``f`` (degrees), ``d_row0`` .. ``d_row3``, ``d_col0`` .. ``d_col3``,
``cs_row``, ``cs_col`` (pixels a magnitude below ``ri_cut``), ``cc_row``, ``cc_col`` (pixels from there on), ``node`` and ``incl`` (degrees). Pixels are (x, y) =
(column, row). All is column arithmetic; the inverse solves its cubic in a fixed number of Newton steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALIBRATION = ("a", "b", "c", "d", "e", "f", "d_row0", "d_row1", "d_row2", "d_row3", "d_col0", "d_col1", "d_col2", "d_col3", "cs_row", "cs_col", "cc_row", "cc_col", "ri_cut", "node", "incl")
NEWTON_STEPS = 12


def _cubic(kind: str, x: Column) -> Column:
    return F.col(f"{kind}0") + x * (F.col(f"{kind}1") + x * (F.col(f"{kind}2") + x * F.col(f"{kind}3")))


def _colour(which: str, colour: Column) -> Column:
    return F.when(colour < F.col("ri_cut"), F.col(f"cs_{which}") * colour).otherwise(F.col(f"cc_{which}"))


def pixel_to_great_circle(x: Column, y: Column, colour: Column) -> tuple[Column, Column]:
    """(mu, nu) in degrees."""
    row = y + _cubic("d_row", x) + _colour("row", colour)
    column = x + _cubic("d_col", x) + _colour("col", colour)
    return F.col("a") + F.col("b") * row + F.col("c") * column, F.col("d") + F.col("e") * row + F.col("f") * column


def great_circle_to_pixel(mu: Column, nu: Column, colour: Column) -> tuple[Column, Column]:
    """(x, y) of great-circle degrees: the affine map undone, then x from its cubic."""
    det = F.col("b") * F.col("f") - F.col("c") * F.col("e")
    away = mu - F.pmod("a", F.lit(360.0))  # a may be any number of turns away
    away = F.when(away < -180, away + 360).when(away > 180, away - 360).otherwise(away)
    up = nu - F.col("d")
    row, column = (F.col("f") * away - F.col("c") * up) / det, (F.col("b") * up - F.col("e") * away) / det
    wanted = column - _colour("col", colour)

    def newton(x: Column, _) -> Column:
        slope = 1 + F.col("d_col1") + x * (2 * F.col("d_col2") + 3 * F.col("d_col3") * x)
        return x - (x + _cubic("d_col", x) - wanted) / slope

    x = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), wanted, newton)
    return x, row - _colour("row", colour) - _cubic("d_row", x)


def great_circle_to_sky(mu: Column, nu: Column) -> tuple[Column, Column]:
    """(ra, dec) in degrees."""
    m, n, i = F.radians(mu - F.col("node")), F.radians(nu), F.radians("incl")
    ra = F.col("node") + F.degrees(F.atan2(F.sin(m) * F.cos(n) * F.cos(i) - F.sin(n) * F.sin(i), F.cos(m) * F.cos(n)))
    z = F.sin(m) * F.cos(n) * F.sin(i) + F.sin(n) * F.cos(i)
    return F.pmod(ra, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def sky_to_great_circle(ra: Column, dec: Column) -> tuple[Column, Column]:
    """(mu, nu) in degrees."""
    r, d, i = F.radians(ra - F.col("node")), F.radians(dec), F.radians("incl")
    mu = F.col("node") + F.degrees(F.atan2(F.sin(r) * F.cos(d) * F.cos(i) + F.sin(d) * F.sin(i), F.cos(r) * F.cos(d)))
    z = F.sin(d) * F.cos(i) - F.sin(r) * F.cos(d) * F.sin(i)
    return F.pmod(mu, F.lit(360.0)), F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))))


def with_sky(pixels: DataFrame, x: str = "x", y: str = "y", colour: str = "colour") -> DataFrame:
    """``pixels``, with the calibration of their fields, and ``ra`` and ``dec`` in degrees; a null colour counts as 0."""
    p = pixels.withColumns(dict(zip(("mu", "nu"), pixel_to_great_circle(F.col(x), F.col(y), F.coalesce(colour, F.lit(0.0))), strict=True)))
    return p.withColumns(dict(zip(("ra", "dec"), great_circle_to_sky(F.col("mu"), F.col("nu")), strict=True))).drop("mu", "nu")


def with_pixels(stars: DataFrame, ra: str = "ra", dec: str = "dec", colour: str = "colour") -> DataFrame:
    """``stars``, with the calibration of a field, and their pixels ``px`` and ``py``."""
    p = stars.withColumns(dict(zip(("mu", "nu"), sky_to_great_circle(F.col(ra), F.col(dec)), strict=True)))
    return p.withColumns(dict(zip(("px", "py"), great_circle_to_pixel(F.col("mu"), F.col("nu"), F.coalesce(colour, F.lit(0.0))), strict=True))).drop("mu", "nu")


def field_paths(fields: DataFrame, pattern: str, keys: tuple[str, ...] = ("run", "camcol", "field", "band")) -> DataFrame:
    """``fields`` with the ``path`` of their product: a printf ``pattern`` over the keys, in order."""
    return fields.withColumn("path", F.format_string(pattern, *map(F.col, keys)))
