"""Images in long form (image, x, y, value): source extraction, block averages, smoothing, resampling and coadds.

A pixel is a row, so that one large image is the work of many tasks. Neighbours along a row or column come from windows over it,
boxes and blocks from grouping, objects from connected components. Sources are looked for in tiles, which are arrays in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyweft.functions import wcs
from skyweft.operators.components import connected_components
from skyweft.operators.spatial import dealt_join, runs_of
from skyweft.session import materialize


def image_sizes(pixels: DataFrame) -> DataFrame:
    """``(image, width, height)`` from the largest coordinates."""
    return pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _neighbours(col: str, along: str, window, k: int):
    """(value, distance) of the rows ``k`` places before and after in the window."""
    return [(f(col, k).over(window), F.abs(f(along, k).over(window) - F.col(along))) for f in (F.lag, F.lead)]


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str] | str, how: str = "inner") -> DataFrame:
    """A join of tables of pixels, or of what there is per image, that broadcasts neither: pixels are guessed to be few where they come from a small file.

    A large image is split among tasks, as any large group in such a join.
    """
    return left.hint("merge").join(right.hint("merge"), keys, how)


def smoothed(pixels: DataFrame, sigma: float, weight: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``(image, x, y, value)``: separable Gaussian over pixels in long form, as far as three sigmas; edges renormalise by the weights they see.

    One window along rows, one along columns, by distance. A missing pixel takes no part and is no place for a sum of its row; a bad one
    that should be such a place has a weight of zero. Columns named in ``keep`` come along.
    """
    reach = max(1, math.ceil(3 * sigma))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p = pixels.select("image", "x", "y", *keep, (F.col("value") * w).alias("total"), w.alias("norm"))
    for along, across in (("x", "y"), ("y", "x")):
        window = Window.partitionBy("image", across).orderBy(along)
        sums = {}
        for c in ("total", "norm"):
            out = F.col(c)
            for k in range(1, reach + 1):
                for v, d in _neighbours(c, along, window, k):
                    out = out + F.coalesce(F.when(d <= reach, v * F.exp(-0.5 * (d / sigma) * (d / sigma))), F.lit(0.0))
            sums[c] = out
        p = p.select("image", "x", "y", *keep, *[v.alias(c) for c, v in sums.items()])
    return p.select("image", "x", "y", *keep, F.when(F.col("norm") > 0, F.col("total") / F.col("norm")).otherwise(0.0).alias("value"))


def background(pixels: DataFrame, half: int = 100) -> DataFrame:
    """``(image, x, y, value)``: medians of boxes of ``half`` pixels to each side, on a grid as wide, joined linearly.

    Boxes that hold the same pixels of their image are one.
    """
    n = image_sizes(pixels)
    p = joined(pixels.select("image", "x", "y", "value"), n, "image")
    zero = F.lit(0).cast("long")
    last = lambda size: F.ceil((F.col(size) - 1) / half).cast("long")
    place = lambda k, size: F.least(k * half, F.col(size) - 1)

    def extent(k, size):
        """Where the box of a place of the grid begins and ends in the image."""
        at = place(k, size)
        return F.struct(F.greatest(zero, at - half).cast("long").alias("lo"), F.least(F.col(size) - 1, at + half).cast("long").alias("hi"))

    def boxes(c, size):
        k = F.floor(F.col(c) / half).cast("long")
        near = F.filter(F.sequence(F.greatest(zero, k - 1), F.least(last(size), k + 2)), lambda i: F.abs(place(i, size) - F.col(c)) <= half)
        return F.array_distinct(F.transform(near, lambda i: extent(i, size)))

    spread = p.withColumn("bx", F.explode(boxes("x", "width"))).withColumn("by", F.explode(boxes("y", "height")))
    medians = spread.groupBy("image", "bx", "by").agg(F.median("value").alias("m"))
    grid = n.withColumn("kx", F.explode(F.sequence(zero, last("width")))).withColumn("ky", F.explode(F.sequence(zero, last("height"))))
    grid = grid.select("image", "kx", "ky", extent(F.col("kx"), "width").alias("bx"), extent(F.col("ky"), "height").alias("by"))
    node = materialize(joined(grid, medians, ["image", "bx", "by"]).select("image", "kx", "ky", "m"), "image-boxes")
    at = lambda i, j: node.select("image", (F.col("kx") - i).alias("kx"), (F.col("ky") - j).alias("ky"), F.col("m").alias(f"m{i}{j}"))
    cells = at(0, 0)
    for i, j in ((1, 0), (0, 1), (1, 1)):
        cells = joined(cells, at(i, j), ["image", "kx", "ky"], "left")
    cell = lambda c, size: F.greatest(zero, F.least(F.floor(F.col(c) / half).cast("long"), last(size) - 1))
    p = joined(p.withColumns({"kx": cell("x", "width"), "ky": cell("y", "height")}), cells, ["image", "kx", "ky"])

    def share(c, k, size):
        lo, hi = F.col(k) * half, place(F.col(k) + 1, size)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    tx, ty = share("x", "kx", "width"), share("y", "ky", "height")
    here = lambda c: F.coalesce(c, F.lit(0.0))  # noqa: E731  beyond the last box the share is zero
    value = (1 - ty) * ((1 - tx) * F.col("m00") + tx * here("m10")) + ty * ((1 - tx) * here("m01") + tx * here("m11"))
    return p.select("image", "x", "y", value.alias("value"))


def noise(pixels: DataFrame, offset: int = 5) -> DataFrame:
    """``(image, sigma)``: differences of pixel pairs on a diagonal, sampled on a grid: 68th percentile over sqrt 2; images too small for pairs are left out."""
    sized = joined(pixels, image_sizes(pixels), "image")
    step = F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.least("width", "height") / 4)))
    p = sized.select("image", "x", "y", "value", step.alias("step"))
    a = p.where("x % step = 0 AND y % step = 0").select("image", "x", "y", "value")
    b = p.where(f"(x - {offset}) % step = 0 AND (y - {offset}) % step = 0").select("image", (F.col("x") - offset).alias("x"), (F.col("y") - offset).alias("y"), F.col("value").alias("other"))
    return joined(a, b, ["image", "x", "y"]).groupBy("image").agg((F.expr("percentile(abs(value - other), 0.6827D)") / math.sqrt(2)).alias("sigma"))


def object_labels(mask: DataFrame) -> DataFrame:
    """``(image, x, y, object)`` of the pixels (image, x, y) of a mask: 8-connected objects, numbered in reading order from 1 in each image.

    Edges between neighbouring pixels go to the connected components, so an image may be as large as it likes.
    """
    pixel = materialize(mask.select(F.col("image").cast("long").alias("image"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct(), "object-pixels")
    node = F.struct("image", "y", "x")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1))])
    a = pixel.select("image", "x", "y", node.alias("src"), F.explode(steps).alias("s"))
    a = a.select("image", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "src")
    edges = a.join(pixel.withColumn("dst", node), ["image", "x", "y"]).select("src", "dst")
    parts = connected_components(edges).select(F.col("node").alias("me"), F.col("component").alias("first"))
    rooted = pixel.withColumn("me", node).join(parts, "me", "left").select("image", "x", "y", F.coalesce("first", "me").alias("first"))
    heads = rooted.select("image", "first").distinct().withColumn("object", F.row_number().over(Window.partitionBy("image").orderBy("first")))
    return rooted.join(heads, ["image", "first"]).select("image", "x", "y", "object")


#: Least side of a tile's core, in pixels.
TILE = 800


def _blurred(total: np.ndarray, norm: np.ndarray, here: np.ndarray, null: np.ndarray, sigma: float, reach: int) -> np.ndarray:
    """:func:`smoothed` of an array whose pixels are there where ``here`` is and have no value where ``null`` is."""
    total, norm = np.where(here & ~null, total, 0.0), norm.astype(float)
    for axis in (1, 0):
        n = total.shape[axis]
        for_axis = lambda a, lo, hi: a[:, lo:hi] if axis else a[lo:hi]  # noqa: B023, E731
        sums = []
        for c in (total, norm):
            out = c.copy()
            for k in range(1, min(reach, n - 1) + 1):
                weight = math.exp(-0.5 * (k / sigma) * (k / sigma))
                for_axis(out, k, n)[...] += for_axis(c, 0, n - k) * weight
                for_axis(out, 0, n - k)[...] += for_axis(c, k, n) * weight
            sums.append(out)
        total, norm = np.where(here & ~null, sums[0], 0.0), np.where(here, sums[1], 0.0)
    return np.divide(total, norm, out=np.zeros_like(total), where=norm > 0)


def _middle(values: np.ndarray) -> float:
    """Median where NaN is the largest value."""
    s = np.sort(values)
    return 0.5 * s[(len(s) - 1) // 2] + 0.5 * s[len(s) // 2]


def _back(value: np.ndarray, known: np.ndarray, size: tuple[int, int], first: tuple[int, int], inner: tuple[slice, slice], half: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`background` of the part ``inner`` of a tile, and where it has none; ``first`` is the tile's first row and column, ``size`` the image's height and width."""
    spots = []
    for n, at, part in zip(size, first, inner, strict=True):
        c = np.arange(part.start, part.stop) + at
        last = -(-(n - 1) // half)
        k = np.clip(c // half, 0, max(0, last - 1))
        lo, hi = k * half, np.minimum((k + 1) * half, n - 1)
        place = np.minimum(np.arange(k[0], k[-1] + 2) * half, n - 1)
        spots.append((k - k[0], np.divide(c - lo, hi - lo, out=np.zeros(len(c)), where=hi > lo), np.maximum(0, place - half) - at, np.minimum(n - 1, place + half) + 1 - at))
    (ky, ty, y0, y1), (kx, tx, x0, x1) = spots
    m, known_boxes = np.zeros((len(y0), len(x0))), {}
    for j, i in np.ndindex(m.shape):
        box = (y0[j], y1[j], x0[i], x1[i])
        if box not in known_boxes:
            inside = slice(*box[:2]), slice(*box[2:])
            seen = value[inside][known[inside]]
            known_boxes[box] = (_middle(seen), True) if len(seen) else (0.0, False)
        m[j, i] = known_boxes[box][0]
    lacks = np.array([[not known_boxes[y0[j], y1[j], x0[i], x1[i]][1] for i in range(len(x0))] for j in range(len(y0))])
    at = lambda a, j, i: a[np.ix_(ky + j, kx + i)]
    ty, tx = ty[:, None], tx[None]
    return (1 - ty) * ((1 - tx) * at(m, 0, 0) + tx * at(m, 0, 1)) + ty * ((1 - tx) * at(m, 1, 0) + tx * at(m, 1, 1)), at(lacks, 0, 0)


def _peaks(x: np.ndarray, y: np.ndarray, value: np.ndarray, null: np.ndarray, size: tuple[int, int], tile: tuple[int, int], core: int, near: int, halo: int, psf: float, half: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """Peaks (x, y, flux, background, height) in a tile's core, and the differences of its pairs for the noise."""
    first = tuple(max(0, t * core - halo) for t in tile)
    shape = tuple(min(n, (t + 1) * core + halo) - f for n, t, f in zip(size, tile, first, strict=True))
    inner = tuple(slice(max(0, t * core - near) - f, min(n, (t + 1) * core + near) - f) for n, t, f in zip(size, tile, first, strict=True))
    image, here, none = np.zeros(shape), np.zeros(shape, bool), np.zeros(shape, bool)
    at = (y - first[0], x - first[1])
    image[at], here[at], none[at] = value, True, null
    back, lacks = _back(image, here & ~none, size, first, inner, half)
    here, none = here[inner], none[inner] | lacks
    flat = image[inner] - back
    soft = _blurred(flat, here, here, none, psf, max(1, math.ceil(3 * psf)))
    known = here & ~none
    row, col = (np.arange(p.start, p.stop) + f for p, f in zip(inner, first, strict=True))
    own = tuple((c >= t * core) & (c < (t + 1) * core) for c, t in zip((row, col), tile, strict=True))
    step = max(1, min(20, min(size) // 4))
    on = [np.flatnonzero(o & (c % step == 0) & (c + offset <= c[-1])) for o, c in zip(own, (row, col), strict=True)]
    a, b = np.ix_(*on), np.ix_(*[i + offset for i in on])
    pairs = np.abs(flat[a] - flat[b])[known[a] & known[b]]
    h, w = soft.shape
    if h < 3 or w < 3:
        return np.empty((0, 5)), pairs
    mid = soft[1:-1, 1:-1]
    top = np.outer(own[0][1:-1], own[1][1:-1])
    for j in range(3):
        for i in range(3):
            top &= known[j : h - 2 + j, i : w - 2 + i] & (mid >= soft[j : h - 2 + j, i : w - 2 + i])
    j, i = (k + 1 for k in np.nonzero(top))
    shifts = []
    for p, q in (((j, i - 1), (j, i + 1)), ((j - 1, i), (j + 1, i))):
        d = soft[p] - 2 * soft[j, i] + soft[q]
        shifts.append(np.divide(0.5 * (soft[p] - soft[q]), d, out=np.full(len(d), np.inf), where=d < 0))
    good = (np.abs(shifts[0]) <= 1) & (np.abs(shifts[1]) <= 1)
    j, i = j[good], i[good]
    fx, fy = col[i] + shifts[0][good], row[j] + shifts[1][good]
    spot = (np.rint(fy).astype(np.int64) - row[0], np.rint(fx).astype(np.int64) - col[0])
    return np.stack([fx, fy, flat[spot], back[spot], soft[j, i]], 1), pairs


def tile_peaks(pixels: DataFrame, sizes: DataFrame, psf: float = 1.0, half: int = 100, offset: int = 5) -> DataFrame:
    """``(image, x, y, flux, background, height, pairs)``: a row a peak of the smoothed images without their background, however low,
    and a row a tile with the differences ``pairs`` that :func:`noise` is made of.

    A tile is an array in a task: its core and what its edge needs for backgrounds and smoothing. A small image is one tile, a large one many.
    ``sizes`` as :func:`image_sizes` returns them. Places are counted from 0; of a pixel given twice one counts.
    """
    core = half * -(-TILE // half)
    near = max(max(1, math.ceil(3 * psf)) + 1, offset)
    halo = near + 2 * half
    spread = lambda c: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / core).cast("int")), F.floor((F.col(c) + halo) / core).cast("int")))
    p = pixels.select("image", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("value").cast("double").alias("value")).where("x >= 0 AND y >= 0")
    p = p.withColumn("tx", spread("x")).withColumn("ty", spread("y"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / core).cast("int")))
    tiles = sizes.where("width > 0 AND height > 0").select("image", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")).withColumn("tx", upto("width")).withColumn("ty", upto("height"))
    keys = ["image", "tx", "ty"]
    rows = dealt_join(p, tiles, keys).select(*keys, "width", "height", "x", "y", "value").sortWithinPartitions(*keys)
    out = T.StructType([T.StructField("image", pixels.schema["image"].dataType), *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "flux", "background", "height")], T.StructField("pairs", T.ArrayType(T.DoubleType()))])

    def found(parts: list[pa.RecordBatch]) -> pa.Table:
        t = pa.Table.from_batches(parts).combine_chunks()
        get = lambda c: t[c].chunk(0).fill_null(0).to_numpy()
        one = lambda c: t[c][0].as_py()
        with np.errstate(all="ignore"):
            peaks, pairs = _peaks(get("x"), get("y"), get("value"), t["value"].chunk(0).is_null().to_numpy(zero_copy_only=False), (one("height"), one("width")), (one("ty"), one("tx")), core, near, halo, psf, half, offset)
        n = len(peaks)
        cols = [pa.array(np.append(c, 0.0), mask=np.append(np.zeros(n, bool), True)) for c in peaks.T]
        return pa.Table.from_arrays([pa.repeat(t["image"][0], n + 1), *cols, pa.array([None] * n + [pairs], pa.list_(pa.float64()))], names=out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, size = [], [], 0
        for batch in batches:
            for part in runs_of(batch, keys):
                if held and any(held[0][c][0] != part[c][0] for c in keys):
                    done.append(found(held))
                    held, size = [], size + done[-1].num_rows
                held.append(part)
            if size > 10_000:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done, size = [], 0
        if held:
            done.append(found(held))
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return rows.mapInArrow(run, out)


def _sources(pixels: DataFrame, sizes: DataFrame, psf: float, limit: float, half: int, most: int | None) -> DataFrame:
    p = materialize(tile_peaks(pixels, sizes, psf, half), "image-peaks")
    sigma = p.where("pairs IS NOT NULL").select("image", F.explode("pairs").alias("far")).groupBy("image").agg((F.expr("percentile(far, 0.6827D)") / math.sqrt(2)).alias("sigma"))
    cut = sigma.select("image", (F.col("sigma") * (limit / (2 * math.sqrt(math.pi) * psf))).alias("cut"))
    p = joined(p.where("pairs IS NULL"), cut, "image", "left").where(F.col("height") > F.coalesce("cut", F.lit(0.0)))
    p = p.withColumn("source", F.row_number().over(Window.partitionBy("image").orderBy(F.desc("flux"), "x", "y")) - 1)
    p = p if most is None else p.where(F.col("source") < most)
    return p.select("image", "source", "x", "y", "flux", "background")


def sources(pixels: DataFrame, psf: float = 1.0, limit: float = 8.0, half: int = 100, most: int | None = 10_000) -> DataFrame:
    """``(image, source, x, y, flux, background)``: the sources of images in long form (image, x, y, value), brightest first in each.

    Background off, smoothed, the highest pixels among the significant ones, their places by parabolas through the 3 x 3 pixels around.
    ``most`` a source list of an image, the brightest (None: all). Pixels are dealt once, by tiles, so a large image is not held by one task.
    """
    return _sources(pixels, image_sizes(pixels), psf, limit, half, most)


def source_table(pixels: DataFrame, retries: int = 3, psf: float = 1.0, limit: float = 8.0, half: int = 100, most: int | None = 10_000) -> DataFrame:
    """:func:`sources` of all images; those without any are halved in size and tried again, up to ``retries`` times. Places are those of the whole image."""
    left, scale, out = pixels.select("image", "x", "y", "value"), 1, None
    for k in range(retries + 1):
        sizes = materialize(image_sizes(left), "image-sizes")
        found = _sources(left, sizes, psf, limit, half, most)
        if k < retries:
            found = materialize(found, "image-sources")
        here = found.select("image", "source", *[((F.col(c) + 0.5) * scale - 0.5).alias(c) for c in ("x", "y")], "flux", "background")
        out = here if out is None else out.unionByName(here)
        if k == retries:
            break
        rest = materialize(joined(sizes.where("width >= 4 AND height >= 4").select("image"), found.select("image").distinct(), "image", "left_anti"), "image-rest")
        if rest.isEmpty():  # no pixel is looked at again
            break
        left, scale = materialize(pixel_blocks(joined(left, rest, "image"), 2).select("image", F.col("bx").alias("x"), F.col("by").alias("y"), "value"), "image-halved"), scale * 2
    return out


def lanczos(d: str, order: int) -> str:
    """Lanczos weight of a distance in pixels, as SQL text."""
    return f"(CASE WHEN {d} = 0 THEN 1.0 WHEN abs({d}) >= {order} THEN 0.0 ELSE {order} * sin(pi() * {d}) * sin(pi() * {d} / {order}) / (pi() * pi() * {d} * {d}) END)"


def coadd(pixels: DataFrame, target_x: str, target_y: str, value: str = "value", weight: str = "weight", order: int = 3, bad: float = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, x, y, value, weight)``: weighted Lanczos sums at whole output pixels of input pixels placed at (target_x, target_y), an image for each of ``keys``.

    Each input pixel reaches (2 order)^2 output pixels; sums are combined before the shuffle.
    """
    reach = F.sequence(F.lit(1 - order), F.lit(order))
    p = pixels.select(*keys, F.col(target_x).alias("tx"), F.col(target_y).alias("ty"), F.col(value).alias("v"), F.col(weight).alias("w"))
    p = p.withColumn("ox", F.explode(reach)).withColumn("oy", F.explode(reach))
    p = p.withColumns({"x": (F.floor("tx") + F.col("ox")).cast("long"), "y": (F.floor("ty") + F.col("oy")).cast("long")})
    p = p.withColumn("k", F.expr(f"{lanczos('(x - tx)', order)} * {lanczos('(y - ty)', order)} * w"))
    total = p.groupBy(*keys, "x", "y").agg(F.sum(F.col("k") * F.col("v")).alias("s"), F.sum("k").alias("weight"))
    return total.select(*keys, "x", "y", F.when(F.abs("weight") > 1e-12, F.col("s") / F.col("weight")).otherwise(bad).alias("value"), "weight")


def pixel_blocks(pixels: DataFrame, size: int, weight: str | None = None, whole: bool = False) -> DataFrame:
    """Block average of long-form pixels (image, x, y, value).

    With ``weight`` a weighted one, zero where all weights of a block are. ``whole`` leaves out blocks cut at an edge.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    total = F.sum(w * F.col("value"))
    g = pixels.groupBy("image", F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by")).agg(total.alias("total"), F.sum(w).alias("weight"), F.count(F.lit(1)).alias("n"))
    g = g.where(F.col("n") == size * size) if whole else g
    value = F.when(F.col("weight") != 0, F.col("total") / F.col("weight")).otherwise(0.0).alias("value")
    return g.select("image", "bx", "by", value, *(["weight"] if weight else []))


def arithmetic(left: DataFrame, right: DataFrame, how: str, keys: tuple[str, ...] = ("image", "x", "y")) -> DataFrame:
    """Two images in long form pixel by pixel: ``+``, ``-``, ``*`` or ``/`` (null where the divisor is zero); pixels of both only."""
    b = right.select(*keys, F.col("value").alias("other"))
    other = F.col("other") if how != "/" else F.when(F.col("other") != 0, F.col("other"))
    value = {"+": F.col("value") + other, "-": F.col("value") - other, "*": F.col("value") * other, "/": F.col("value") / other}[how]
    return left.join(b, list(keys)).select(*keys, value.alias("value"))


def scaled_image(pixels: DataFrame, scale: float = 1.0, offset: float = 0.0) -> DataFrame:
    """``value * scale + offset`` of every pixel."""
    return pixels.withColumn("value", F.col("value") * scale + offset)


def resample(pixels: DataFrame, source: wcs.Tan, target: wcs.Tan, order: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """Pixels of one projection at the whole pixels of another: placed through the sky, summed with Lanczos weights; images of ``keys`` apart."""
    x, y, z = wcs.pixel_to_xyz(source, "x", "y")
    px, py = wcs.sky_to_pixel(target, "sx", "sy", "sz")
    sky = pixels.select(*keys, "value", F.expr(x).alias("sx"), F.expr(y).alias("sy"), F.expr(z).alias("sz"))
    placed = sky.select(*keys, "value", F.expr(px).alias("tx"), F.expr(py).alias("ty"), F.lit(1.0).alias("weight")).where("tx is not null and ty is not null")
    out = coadd(placed, "tx", "ty", order=order, keys=keys)
    return out.where(wcs.in_image(target, "x", "y")) if target.size != (0.0, 0.0) else out


def image_statistics(pixels: DataFrame) -> DataFrame:
    """Size, range, mean and spread of the values of each image."""
    return pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"))
