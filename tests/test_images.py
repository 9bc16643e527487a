"""Images in long form against their forms as arrays."""

import numpy as np
import pytest
from image_arrays import block_average, extract_sources, label_components, median_background, noise_sigma, smooth
from pyspark.sql import functions as F

from skyweft.operators import images


def _image(seed, h, w, stars, noise=1.0):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    out = r.normal(100, noise, (h, w)) + 0.05 * x
    for _ in range(stars):
        cx, cy, f = r.uniform(3, w - 4), r.uniform(3, h - 4), r.uniform(60, 400)
        out += f * np.exp(-0.5 * ((x - cx) ** 2 + (y - cy) ** 2))
    return out


def _rows(spark, arrays):
    return spark.createDataFrame([(k, int(x), int(y), float(a[y, x])) for k, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])], "image long, x long, y long, value double").repartition(5)


def _array(df, shape, image):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image") == image).collect():
        out[r.y, r.x] = r.value
    return out


@pytest.fixture(scope="module")
def some():
    return {1: _image(1, 50, 70, 6), 2: _image(2, 31, 24, 2), 3: _image(3, 9, 40, 1), 4: _image(4, 1, 30, 0), 5: _image(5, 12, 1, 0)}


@pytest.mark.parametrize("half", [4, 10, 100])
def test_backgrounds(spark, some, half):
    got = images.background(_rows(spark, some), half)
    for k, a in some.items():
        assert np.allclose(_array(got, a.shape, k), median_background(a, half))


def test_smoothing_and_noise(spark, some):
    df = _rows(spark, some)
    for psf in (0.8, 1.5):
        got = images.smoothed(df, psf)
        for k, a in some.items():
            assert np.allclose(_array(got, a.shape, k), smooth(a, psf))
    weights = {k: np.random.default_rng(k).integers(0, 3, a.shape).astype(float) for k, a in some.items()}
    weighted = df.join(_rows(spark, weights).withColumnRenamed("value", "w"), ["image", "x", "y"])
    got = images.smoothed(weighted, 1.0, "w")
    for k, a in some.items():
        assert np.allclose(_array(got, a.shape, k), smooth(a, 1.0, weights[k]))
    sigma = {r.image: r.sigma for r in images.noise(df).collect()}
    assert all(abs(sigma.get(k, 0.0) - noise_sigma(a)) < 1e-9 for k, a in some.items()) and set(sigma) == {1, 2, 3}


@pytest.mark.parametrize("seed", range(3))
def test_objects(spark, seed):
    r = np.random.default_rng(seed)
    masks = {k: r.random((int(r.integers(1, 14)), int(r.integers(1, 14)))) < 0.45 for k in range(4)}
    rows = [(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    got = images.object_labels(spark.createDataFrame(rows + rows[:3], "image long, x long, y long"))
    want = {(k, x, y): int(label_components(masks[k])[y, x]) for k, x, y in rows}
    assert {(o.image, o.x, o.y): o.object for o in got.collect()} == want and got.count() == len(want)
    assert images.object_labels(got.select("image", "x", "y").limit(0)).count() == 0


def test_sources(spark, some):
    df = _rows(spark, some)
    for how in ({"half": 20}, {"half": 9, "psf": 1.4, "limit": 5.0}, {"half": 20, "most": 3}):
        found: dict = {k: [] for k in some}
        for r in images.sources(df, **how).orderBy("image", "source").collect():
            found[r.image].append((r.x, r.y, r.flux, r.background))
        for k, a in some.items():
            want = extract_sources(a, **how)
            assert len(want) == len(found[k]) and (not want or np.allclose(want, found[k])), k
    assert sum(len(extract_sources(a, half=20)) for a in some.values()) >= 7
    assert images.sources(df, half=20).count() == images.sources(df, half=20, most=None).count()


def test_images_without_sources_are_halved(spark):
    r = np.random.default_rng(7)
    y, x = np.mgrid[:64, :64]
    wide = r.normal(50, 3, (64, 64)) + 4 * np.exp(-0.5 * ((x - 30) ** 2 + (y - 22) ** 2) / 49)
    both = {1: _image(8, 40, 40, 2), 2: wide, 3: np.full((6, 6), 4.0)}
    got = {k: sorted((s.x, s.y) for s in images.source_table(_rows(spark, both), half=100).collect() if s.image == k) for k in both}
    want, scale, data = [], 1, wide
    while not want and scale <= 8:
        want = sorted(((a + 0.5) * scale - 0.5, (b + 0.5) * scale - 0.5) for a, b, *_ in extract_sources(data))
        data, scale = block_average(data, 2), scale * 2
    assert scale > 2 and np.allclose(got[2], want) and len(got[1]) == len(extract_sources(both[1])) and got[3] == []


def test_block_average_of_a_cut_edge(spark):
    a = np.arange(6.0).reshape(2, 3)
    got = images.pixel_blocks(_rows(spark, {1: a}), 2).select("image", F.col("bx").alias("x"), F.col("by").alias("y"), "value")
    assert _array(got, (1, 2), 1).tolist() == [[2.0, 3.5]] == block_average(a, 2).tolist()


def test_pixels_are_not_broadcast(spark, some, monkeypatch):
    """Pixels made from a small file are guessed to be few: no join of the sources' plans may broadcast them."""
    plans = []
    kept = images.materialize

    def noted(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, label)

    monkeypatch.setattr(images, "materialize", noted)
    out = images.source_table(_rows(spark, some), half=20)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any("BroadcastHashJoin" in p or "BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize("tile", [7, 16, 800])
def test_sources_of_images_cut_into_tiles(spark, some, monkeypatch, tile):
    """The same sources whatever the tiles, also where pixels are missing, null or NaN; pixels are read twice, for the sizes and for the tiles."""
    monkeypatch.setattr(images, "TILE", tile, raising=False)
    df = _rows(spark, some)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    seen = df.mapInArrow(counted, df.schema)
    for how in ({"half": 9, "psf": 1.4, "limit": 5.0}, {"half": 4, "limit": 6.0}):
        read.value = 0
        found = images.sources(seen, **how).orderBy("image", "source").collect()
        assert read.value <= 2 * sum(a.size for a in some.values())
        for k, a in some.items():
            want, got = extract_sources(a, **how), [(r.x, r.y, r.flux, r.background) for r in found if r.image == k]
            assert len(want) == len(got) and (not want or np.allclose(want, got)), k
    holes = df.where("(7 * x + 3 * y) % 41 <> 5").withColumn("value", F.expr("CASE WHEN (x + 5 * y) % 97 = 3 THEN NULL WHEN image = 2 AND x = 20 AND y = 25 THEN double('NaN') ELSE value END"))
    got = [tuple(r) for r in images.sources(holes, half=9, limit=5.0).orderBy("image", "source").collect()]
    soft = images.smoothed(_without_background(holes, 9), 1.0).where("value IS NOT NULL")
    top = {(r.image, r.x, r.y): r.value for r in soft.collect()}
    peaks = {(k, x, y) for (k, x, y), v in top.items() if all(top.get((k, x + i, y + j), np.inf) <= v for i in (-1, 0, 1) for j in (-1, 0, 1))}
    assert len(got) > 3 and all(any((k, round(x) + i, round(y) + j) in peaks for i in (-1, 0, 1) for j in (-1, 0, 1)) for k, _, x, y, *_ in got)


def _without_background(df, half):
    back = images.background(df, half).withColumnRenamed("value", "back")
    return df.join(back, ["image", "x", "y"]).select("image", "x", "y", (F.col("value") - F.col("back")).alias("value"))
