import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import images, kernels, psf_field, starlight, tiles

from .test_tiles import back, frame


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:53, 0:70]
    return np.round(200 + 3 * y + 5 * x + rng.normal(0, 20, y.shape)).astype(np.float32)


def test_starlet_is_the_whole_images_and_sums_to_it_exactly(spark, image):
    cut = tiles.from_pixels(frame(spark, {"a": image}), ["img"], 32)
    scales = 4
    out = images.starlet(cut, ["img"], scales).cache()
    r = kernels.starlet_reach(scales)
    assert r == 30
    want = kernels.starlet(np.pad(image.astype(float), r, mode="reflect"), scales)
    got = [back(out.filter(F.col("scale") == j), image.shape) for j in range(scales + 1)]
    for g, w in zip(got, want, strict=True):
        assert np.array_equal(g, w)
    assert np.array_equal(sum(got), image)
    with pytest.raises(Exception, match="larger tiles"):
        images.starlet(tiles.from_pixels(frame(spark, {"a": image}), ["img"], 16), ["img"], scales).count()


def test_shrinking_lowers_noise_and_keeps_a_source(spark):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:48, 0:48]
    truth = 400 * np.exp(-((y - 24) ** 2 + (x - 20) ** 2) / 8)
    noisy = (truth + rng.normal(0, 10, y.shape)).astype(np.float32)
    planes = images.starlet(tiles.from_pixels(frame(spark, {"a": noisy}), ["img"], 24), ["img"], 3)
    got = back(images.denoised(planes, ["img"], 3, [3.0, 3.0, 2.0]), noisy.shape)
    far = np.hypot(y - 24, x - 20) > 10
    assert got[far].std() < 0.45 * noisy[far].std() and abs(got[24, 20] - 400) < 80
    sigma = {r.scale: r.sigma for r in images.scale_noise(planes, ["img"], 3).collect()}
    assert set(sigma) == {0, 1, 2} and 7 < sigma[0] < 11 > sigma[1] > sigma[2]
    assert np.allclose(back(images.denoised(planes, ["img"], 3, [0.0]), noisy.shape), noisy)


def test_local_linear_equals_a_fit_at_every_pixel(spark, image):
    a = image.astype(float)[:30, :41]
    a[np.random.default_rng(2).random(a.shape) < 0.3] = np.nan
    a[10:30, 25:41] = np.nan
    rows = [("a", y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(30) for x in range(41)]
    cut = tiles.from_pixels(spark.createDataFrame(rows, "img string, y int, x int, v double"), ["img"], 16)
    got = back(images.local_linear(cut, ["img"], 1.5), a.shape)
    r = kernels.gaussian_reach(1.5)
    for y, x in [(0, 0), (29, 0), (5, 40), (15, 15), (12, 27), (12, 24), (20, 24)]:
        ys, xs = np.mgrid[max(0, y - r) : min(30, y + r + 1), max(0, x - r) : min(41, x + r + 1)]
        v = a[ys, xs]
        ok = np.isfinite(v)
        w = np.sqrt(np.exp(-0.5 * ((ys - y) ** 2 + (xs - x) ** 2) / 1.5**2))[ok]
        fit = np.linalg.lstsq(np.c_[np.ones(ok.sum()), ys[ok] - y, xs[ok] - x] * w[:, None], v[ok] * w, rcond=None)[0]
        assert abs(got[y, x] - fit[0]) < 1e-3 * abs(fit[0]), (y, x)
    assert np.isnan(got[25, 36])
    plane = 3.0 * np.mgrid[0:30, 0:41][0] - 2.0 * np.mgrid[0:30, 0:41][1]
    cut = tiles.from_pixels(frame(spark, {"a": plane}), ["img"], 16)
    assert np.allclose(back(images.local_linear(cut, ["img"], 2.0), plane.shape), plane, atol=1e-4)


def test_distances_and_filling_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    shapes = {"a": (37, 45), "b": (5, 60), "c": (1, 1), "none": (6, 6)}
    rows, seeds = [], {}
    for k, (h, w) in shapes.items():
        seeds[k] = [(int(y), int(x)) for y in range(h) for x in range(w) if k != "none" and rng.random() < 0.03] or ([(0, 0)] if k != "none" else [])
        rows += [(k, y, x, float(100 * y + x) if (y, x) in seeds[k] else None) for y in range(h) for x in range(w) if rng.random() < 0.8 or (y, x) in seeds[k] or (y, x) == (h - 1, w - 1)]
    got = images.filled(spark.createDataFrame(rows, "img string, y int, x int, v double"), ["img"]).collect()
    assert len(got) == sum(h * w for h, w in shapes.values())
    for r in got:
        if not seeds[r.img]:
            assert r.v is None and r.d2 is None
        else:
            d2, sx, sy = min(((r.y - y) ** 2 + (r.x - x) ** 2, x, y) for y, x in seeds[r.img])
            assert (r.d2, r.v) == (d2, 100.0 * sy + sx)


def flood(mask):
    out = np.full(mask.shape, -1, np.int64)
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x] < 0:
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and out[a, b] < 0:
                    out[a, b] = (int(y) << 31) + int(x)
                    todo += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


def test_regions_across_tiles(spark):
    rng = np.random.default_rng(6)
    masks = {"a": rng.random((40, 50)) < 0.58, "ring": np.zeros((33, 33), bool), "full": np.ones((20, 20), bool), "empty": np.zeros((4, 4), bool)}
    spiral = masks["ring"]
    # A line that winds through every tile.
    for k in range(0, 33, 4):
        spiral[k, :] = True
        spiral[k : k + 5, 32 if k // 4 % 2 == 0 else 0] = True
    rows = [(k, y, x, bool(m[y, x])) for k, m in masks.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    got = images.regions(spark.createDataFrame(rows, "img string, y int, x int, m boolean"), ["img"], "m", 8).collect()
    want = {k: flood(m) for k, m in masks.items()}
    assert len(got) == sum(m.sum() for m in masks.values()) and all(r.region == want[r.img][r.y, r.x] for r in got)
    assert len({r.region for r in got if r.img == "ring"}) == 1
    for m in masks.values():
        inside = kernels.regions(m)
        assert ((inside >= 0) == m).all() and np.array_equal(np.where(m, (inside // m.shape[1] << 31) + inside % m.shape[1], -1), flood(m))


def test_contrast_has_no_seams_and_a_limit(spark):
    y, x = np.mgrid[0:48, 0:64]
    flat = 0.3 + 0.1 * x / 64
    out = back(images.local_contrast(frame(spark, {"a": flat}), ["img"], 16, clip=1.5, bins=256).select("img", "y", "x", F.col("out").alias("v")), flat.shape)
    assert (np.abs(np.diff(out, axis=0)) < 1e-9).all()
    steps = np.diff(out, axis=1)
    assert steps.max() < 0.05 and steps.min() > -0.02
    assert np.allclose(back(images.local_contrast(frame(spark, {"a": flat}), ["img"], 16, amount=0.0).select("img", "y", "x", F.col("out").alias("v")), flat.shape), flat)


def test_field_of_kernels_recovers_what_made_the_stamps(spark):
    rng = np.random.default_rng(3)
    h, w, half = 200, 300, 4
    dy, dx = np.mgrid[-half : half + 1, -half : half + 1]

    def true(y, x):
        s = 1.0 + 0.8 * x / w
        k = np.exp(-0.5 * (dy**2 + dx**2) / s**2)
        return k / k.sum()

    stars = [(i, float(rng.integers(0, h)), float(rng.integers(0, w))) for i in range(220)]
    rows = []
    for i, y, x in stars:
        k = true(y, x) + rng.normal(0, 1e-4, dy.shape)
        if i % 20 == 0:
            k[1, 2] += 0.5
        rows += [("k", i, y, x, int(a), int(b), float(v)) for a, b, v in zip(dy.ravel(), dx.ravel(), k.ravel())]
    stamps = spark.createDataFrame(rows, "img string, star_id int, y double, x double, dy int, dx int, v double")
    coefs = psf_field.fit(stamps, ["img"], h, w, 2)
    ys, xs = psf_field.nodes(h, w, 110)
    assert (len(ys), len(xs)) == (3, 4) and xs[-1] == w - 1
    field = psf_field.collected(psf_field.node_kernels(coefs, ["img"], h, w, 110, 2), half)
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            assert np.abs(field[i, j] - true(y, x)).max() < 0.012 and abs(field[i, j].sum() - 1) < 1e-9
    loose = psf_field.collected(psf_field.node_kernels(psf_field.fit(stamps, ["img"], h, w, 2, clip=None), ["img"], h, w, 110, 2), half)
    assert np.abs(loose[1, 1] - true(ys[1], xs[1])).max() > 0.015


def test_neighbours_leave_a_stamp(spark):
    half = 3
    d = np.arange(-half, half + 1)
    k = np.exp(-0.5 * (d[:, None] ** 2 + d[None] ** 2) / 1.2**2)
    k /= k.sum()
    stars = [(1, 20, 20, 100.0), (2, 22, 19, 300.0), (3, 20, 25, 50.0), (4, 60, 60, 10.0)]
    scene = np.zeros((80, 80))
    for _, y, x, f in stars:
        scene[y - half : y + half + 1, x - half : x + half + 1] += f * k
    stamps = spark.createDataFrame([("a", i, int(a), int(b), float(scene[y + a, x + b])) for i, y, x, _ in stars for a in d for b in d], "img string, star_id int, dy int, dx int, v double")
    sdf = spark.createDataFrame([("a", *s) for s in stars], "img string, star_id int, y int, x int, flux double")
    kdf = spark.createDataFrame([("a", int(a), int(b), float(k[a + half, b + half])) for a in d for b in d], "img string, dy int, dx int, v double")
    got = psf_field.neighbours_subtracted(stamps, sdf, kdf, ["img"], half).collect()
    assert len(got) == 4 * 49
    flux = {i: f for i, _, _, f in stars}
    assert all(abs(r.v - flux[r.star_id] * k[r.dy + half, r.dx + half]) < 1e-9 for r in got)


def test_convolution_varies_pixel_by_pixel(spark):
    rng = np.random.default_rng(9)
    h, w, half, spacing = 40, 56, 2, 20.0
    ys, xs = psf_field.nodes(h, w, spacing)
    field = rng.random((len(ys), len(xs), 5, 5))
    field /= field.sum((2, 3), keepdims=True)
    a = rng.integers(0, 500, (h, w)).astype(float)
    a[3, 3] = np.nan
    wy, wx = psf_field.shares(np.arange(h), ys), psf_field.shares(np.arange(w), xs)
    assert np.allclose(wy.sum(1), 1) and np.allclose(wy @ np.array(ys), np.arange(h))
    want = np.zeros((h + 4, w + 4))
    for y in range(h):
        for x in range(w):
            if np.isfinite(a[y, x]):
                want[y : y + 5, x : x + 5] += a[y, x] * np.einsum("i,j,ijkl->kl", wy[y], wx[x], field)
    rows = spark.createDataFrame([("a", y, x, None if np.isnan(a[y, x]) else float(a[y, x])) for y in range(h) for x in range(w)], "img string, y int, x int, v double")
    got = back(tiles.to_pixels(psf_field.convolve(tiles.from_pixels(rows, ["img"], 16), ["img"], field, h, w, spacing), ["img"]), a.shape)
    assert np.allclose(got, want[2:-2, 2:-2], rtol=1e-5)
    # Light that leaves the image apart, a source keeps its light.
    dot = np.zeros((h, w))
    dot[20, 30] = 1000
    got = back(tiles.to_pixels(psf_field.convolve(tiles.from_pixels(frame(spark, {"a": dot}), ["img"], 16), ["img"], field, h, w, spacing), ["img"]), a.shape)
    assert abs(got.sum() - 1000) < 1e-2


def test_stars_get_their_light_though_they_overlap(spark):
    rng = np.random.default_rng(5)
    stars = [(0, 10, 10), (1, 10, 14), (2, 13, 12), (3, 30, 30), (4, 32, 33), (5, 60, 60), (6, 5, 45)]
    sdf = spark.createDataFrame([("a", *s) for s in stars], "img string, star_id int, y int, x int")
    v = rng.uniform(1, 100, (50, 50))
    v[0, 0], v[5, 45] = -3, 0
    pixels = frame(spark, {"a": v})
    prints = starlight.footprints(sdf, ["img"], 4, 2.0).cache()
    shares = {(r.star_id, r.y, r.x): r.share for r in prints.collect()}
    total = {}
    for (_, y, x), s in shares.items():
        total[y, x] = total.get((y, x), 0) + s
    assert all(abs(t - 1) < 1e-12 for t in total.values())
    now = {i: sum(s * v[y, x] for (k, y, x), s in shares.items() if k == i and y < 50 and x < 50 and v[y, x] > 0) for i, _, _ in stars}
    wanted = {i: now[i] * f for i, f in ((0, 1.4), (1, 0.7), (2, 1.0), (3, 0.5), (4, 2.0), (6, 1.1))} | {5: 10.0}
    out, light = starlight.conserved(pixels, prints, spark.createDataFrame([("a", i, float(f)) for i, f in wanted.items()], "img string, star_id int, wanted double"), ["img"], 1e-9)
    got = back(out, v.shape)
    rows = {r.star_id: r for r in light.collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 6} and rows[0].rounds < 100
    for i, r in rows.items():
        flux = sum(s * got[y, x] for (k, y, x), s in shares.items() if k == i and y < 50 and x < 50 and v[y, x] > 0)
        assert abs(flux / wanted[i] - 1) < 1e-6 and abs(r.light / wanted[i] - 1) < 1e-6
    outside = [(y, x) for y in range(50) for x in range(50) if (y, x) not in total]
    assert all(got[p] == v[p] for p in outside) and got[5, 45] == 0 and (got[v > 0] > 0).all()
