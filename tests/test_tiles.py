import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import geometry, kernels, tiles


def frame(spark, images):
    rows = [(k, int(y), int(x), float(a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "img string, y int, x int, v double")


def back(df, shape, img="a"):
    out = np.full(shape, np.nan)
    for r in df.filter(F.col("img") == img).collect():
        out[r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(2).normal(100, 10, (37, 50)).astype(np.float32)


@pytest.fixture(scope="module")
def cut(spark, image):
    return tiles.from_pixels(frame(spark, {"a": image, "b": image * 2}), ["img"], 16).cache()


def test_round_trip(cut, image):
    assert np.array_equal(back(tiles.to_pixels(cut, ["img"]), image.shape), image)


@pytest.mark.parametrize("name", ["blur", "median", "dilate", "erode"])
def test_kernels_do_not_see_tiles(cut, image, name):
    """Tiled results equal those of the whole image."""
    pad = lambda r: np.pad(image.astype(float), r, mode="reflect")
    if name == "blur":
        out, want = tiles.blur(cut, ["img"], 1.5), kernels.gaussian(pad(kernels.gaussian_reach(1.5)), 1.5)
    elif name == "median":
        out, want = tiles.median_filter(cut, ["img"], 2), kernels.median(pad(2), 2)
    else:
        out = (tiles.dilate if name == "dilate" else tiles.erode)(cut, ["img"], 3)
        want = (kernels.maximum if name == "dilate" else kernels.minimum)(pad(3), 3)
    assert np.allclose(back(tiles.to_pixels(out, ["img"]), image.shape), want, atol=1e-4)


def test_stars_across_tile_borders(spark):
    y, x = np.mgrid[0:48, 0:48]
    places = [(16.0, 16.3), (8.4, 30.2), (33.0, 15.6)]
    a = 10 + sum(500 * np.exp(-((y - py) ** 2 + (x - px) ** 2) / 4.5) for py, px in places) + np.random.default_rng(1).normal(0, 0.5, y.shape)
    got = tiles.detect_stars(tiles.from_pixels(frame(spark, {"a": a}), ["img"], 16), ["img"], 4, 20).collect()
    assert len(got) == 3
    for py, px in places:
        assert min(np.hypot(r.y - py, r.x - px) for r in got) < 0.1
    assert all(2.5 < r.fwhm < 4.2 and r.ellipticity < 0.15 for r in got)


def test_mosaic(spark):
    y, x = np.mgrid[0:20, 0:20]
    raw = np.where((y % 2 == 0) & (x % 2 == 0), 30.0, np.where((y % 2 == 1) & (x % 2 == 1), 10.0, 20.0))
    cutout = tiles.from_pixels(frame(spark, {"a": raw}), ["img"], 8)
    for channel, value in (("R", 30.0), ("G", 20.0), ("B", 10.0)):
        assert np.allclose(back(tiles.to_pixels(tiles.demosaic(cutout, ["img"], "RGGB", channel), ["img"]), raw.shape), value)
    raw[9, 9] = 500
    fixed = back(tiles.to_pixels(tiles.repair_defects(tiles.from_pixels(frame(spark, {"a": raw}), ["img"], 8), ["img"], 50.0), ["img"]), raw.shape)
    assert fixed[9, 9] == 10.0 and fixed[8, 8] == 30.0


def test_restoration_sharpens_and_keeps_light(spark):
    rng = np.random.default_rng(3)
    truth = np.full((32, 32), 20.0)
    truth[16, 12] = truth[9, 20] = 2000
    g = np.exp(-0.5 * (np.arange(-4, 5) / 1.3) ** 2)
    kernel = np.outer(g, g) / g.sum() ** 2
    blurred = kernels.gaussian(np.pad(truth, kernels.gaussian_reach(1.3), mode="reflect"), 1.3)
    exposures = np.stack([blurred + rng.normal(0, 1, truth.shape) for _ in range(6)])
    x, rounds = kernels.mm_restore(exposures, np.ones_like(exposures), np.ones_like(exposures, bool), np.repeat(kernel[None], 6, 0), 60)
    assert x[16, 12] > 1.6 * blurred[16, 12] and abs(x.sum() / truth.sum() - 1) < 0.03 and rounds <= 60
    rows = [(i, 0, 0, 0, 0, 32, 32, bytearray(e.astype(np.float32).tobytes()), kernel.ravel().tolist()) for i, e in enumerate(exposures)]
    df = spark.createDataFrame([("a", *r) for r in rows], "img string, frame int, ty int, tx int, y0 int, x0 int, h int, w int, data binary, kernel array<double>")
    got = np.frombuffer(tiles.restore(df, ["img"], "frame", "kernel", 1.0, 60).first().data, np.float32).reshape(32, 32)
    assert np.allclose(got, x, rtol=1e-3)
    sharp = kernels.richardson_lucy(blurred, kernel, 20)
    assert sharp[16, 12] > 2 * blurred[16, 12]
    assert np.allclose(kernels.fourier_shift(kernels.fourier_shift(blurred, 0.3, -0.7), -0.3, 0.7), blurred, atol=0.1)


def test_rectangle():
    rng = np.random.default_rng(5)
    for _ in range(30):
        m = rng.random((6, 7)) < 0.7
        y, x, h, w = kernels.largest_rectangle(m)
        assert m[y : y + h, x : x + w].all()
        best = max((b - a) * (d - c) for a in range(6) for b in range(a + 1, 7) for c in range(7) for d in range(c + 1, 8) if m[a:b, c:d].all()) if m.any() else 0
        assert h * w == best


def test_affine_coverage_drizzle(spark):
    rng = np.random.default_rng(4)
    p = rng.uniform(0, 100, (60, 2))
    q = p @ np.array([[1.01, -0.02], [0.02, 0.99]]).T + [3, -5]
    rows = [("k", float(x), float(y), float(u), float(v)) for (x, y), (u, v) in zip(p, q)] + [("k", 50.0, 50.0, 500.0, 500.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, x2 double, y2 double")
    kept = geometry.residual_clip(df, geometry.affine_fit(df, ["k"]), ["k"])
    for _ in range(3):
        kept = geometry.residual_clip(kept, geometry.affine_fit(kept, ["k"]), ["k"])
    f = geometry.affine_fit(kept, ["k"]).first()
    assert np.allclose([f.a, f.b, f.c, f.d, f.e, f.f], [1.01, -0.02, 3, 0.02, 0.99, -5], atol=1e-6)
    one = [float(v) for v in (1, 0, 0, 0, 1, 0, 0, 0, 1)]
    frames = spark.createDataFrame([(1, one), (2, [float(v) for v in (1, 0, 4, 0, 1, 2, 0, 0, 1)])], "frame int, hm array<double>")
    assert [r.i for r in frames.select(geometry.is_identity(F.col("hm")).alias("i")).collect()] == [True, False]
    cover = {(r.cy, r.cx): r.frames for r in geometry.coverage(geometry.footprints(frames, "frame", "hm", 10, 6), 1.0).collect()}
    assert sum(cover.values()) == 120 and cover[3, 5] == 2 and cover[0, 0] == 1 and cover[7, 13] == 1
    pixels = spark.createDataFrame([("k", y, x, float(y + x)) for y in range(6) for x in range(6)], "k string, y int, x int, v double")
    fine = geometry.drizzle(pixels, ["k"], 2.0, 1.0, F.lit(0.0), F.lit(0.0)).collect()
    assert len(fine) == 144 and all(abs(r.v - (r.oy // 2 + r.ox // 2)) < 1e-9 and abs(r.weight - 1) < 1e-9 for r in fine)
    moved = geometry.drizzle(pixels, ["k"], 1.0, 0.5, F.lit(0.5), F.lit(0.0)).groupBy().agg(F.sum("weight").alias("w")).first()
    assert abs(moved.w - 36 * 0.25) < 1e-9


def test_decisions(spark):
    df = spark.createDataFrame([(2.0, True, None, False), (1.0, True, None, False), (3.0, True, 2.0, False), (2.0, False, None, False)], "s double, cfa boolean, p double, d boolean")
    got = [tuple(r.r) for r in df.select(geometry.resampling(F.col("s"), F.col("cfa"), F.col("p"), F.col("d")).alias("r")).collect()]
    assert got == [("drizzle", 2.0, 0.5), ("drizzle", 1.0, 1.0), ("drizzle", 3.0, 1.0), ("lanczos4", 1.0, None)]
    r = df.select(geometry.rejection(F.lit(None).cast("string"), F.lit("drizzle"), F.col("s"), F.lit(0.0), F.lit(None).cast("double")).alias("r")).first().r
    assert tuple(r) == ("mad", 4.0, 3.0)
