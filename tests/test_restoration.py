import numpy as np
import pytest

from photonframe.operators import restoration, tiles

from .test_tiles import frame


def kernel(half, s):
    d = np.arange(-half, half + 1)
    k = np.exp(-0.5 * (d[:, None] ** 2 + d[None] ** 2) / s**2)
    return k / k.sum()


@pytest.mark.parametrize("noise", [0.0, 3.0])
def test_clipped_stars_have_their_known_light(spark, noise):
    rng = np.random.default_rng(1)
    half, level = 7, 4000.0
    k = kernel(half, 1.8)
    known = {i: f for i, f in enumerate([2e4, 8e4, 3e5, 2e6, 5e6])}
    rows = []
    for i, f in known.items():
        v = np.minimum(f * k + 150 + rng.normal(0, noise, k.shape), level)
        rows += [("a", i, int(y) - half, int(x) - half, float(v[y, x])) for y in range(15) for x in range(15)]
    rows += [("a", 9, y, x, level) for y in range(-2, 3) for x in range(-2, 3)] + [("a", 9, 5, 5, None)]
    stamps = spark.createDataFrame(rows, "img string, star_id int, dy int, dx int, v double")
    psf = spark.createDataFrame([("a", y - half, x - half, float(k[y, x])) for y in range(15) for x in range(15)], "img string, dy int, dx int, p double")
    got = {r.star_id: r for r in restoration.saturated_light(stamps, psf, ["img"], level, noise).collect()}
    assert set(got) == {*known, 9} and got[9].light is None and got[9].clipped == 25 and got[9].used == 0
    for i, f in known.items():
        assert abs(got[i].light / f - 1) < 0.01 and abs(got[i].sky - 150) < 2 + 2 * noise and got[i].clipped + got[i].used == 225
    assert got[0].clipped == 0 < got[1].clipped < got[4].clipped
    naive = {i: sum(r[4] - 150 for r in rows if r[1] == i) for i in known}
    assert naive[4] < 0.3 * known[4]


def test_clipped_pixels_raise_a_fit_that_stays_below_them(spark):
    k = kernel(2, 1.0)
    rows = [("a", 1, y - 2, x - 2, 100.0 if (y, x) == (2, 2) else 10.0) for y in range(5) for x in range(5)]
    stamps = spark.createDataFrame(rows, "img string, star_id int, dy int, dx int, v double")
    psf = spark.createDataFrame([("a", y - 2, x - 2, float(k[y, x])) for y in range(5) for x in range(5)], "img string, dy int, dx int, p double")
    r = restoration.saturated_light(stamps, psf, ["img"], 100.0).first()
    assert abs(r.light * k[2, 2] + r.sky - 100) < 1e-9 and abs(r.sky - 10) < 1e-9 and r.clipped == 1


def test_steps_reach_the_minimum_of_a_dense_solve():
    rng = np.random.default_rng(2)
    for _ in range(5):
        a = rng.normal(size=(60, 9))
        true = rng.dirichlet(np.ones(9))
        gram, right = a.T @ a, a.T @ (a @ true)
        k, taken = restoration.accelerated(gram, right, np.full(9, 1 / 9), 5000, 1e-13)
        assert taken < 5000 and np.abs(k - np.linalg.solve(gram, right)).max() < 1e-8
        # A demand outside the simplex: no feasible direction from the result goes downhill.
        right = right + rng.normal(0, 30, 9)
        k, _ = restoration.accelerated(gram, right, np.full(9, 1 / 9), 5000, 1e-13)
        slope = gram @ k - right
        assert abs(k.sum() - 1) < 1e-12 and k.min() >= 0 and np.abs(slope[k > 1e-9] - slope[k > 1e-9].mean()).max() < 1e-5 and (slope >= slope[k > 1e-9].mean() - 1e-5).all()
    assert restoration.accelerated(np.eye(4), np.zeros(4), np.full(4, 0.25), 3, 0.0)[1] == 3


def test_kernels_of_frames_are_recovered_across_tiles(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 100, (40, 50)).astype(float)
    half = 2
    kernels = {"a": kernel(half, 0.8), "b": kernel(half, 1.4), "c": np.eye(5) / 5}
    frames = {}
    for name, k in kernels.items():
        wide = np.zeros((44, 54))
        for dy in range(5):
            for dx in range(5):
                wide[dy : dy + 40, dx : dx + 50] += k[dy, dx] * x
        frames[name] = wide[2:-2, 2:-2]
    frames["b"][5, :30] = np.nan
    image = tiles.from_pixels(frame(spark, {"m": x}), ["img"], 16)
    rows = [("m", f, y, c, None if np.isnan(a[y, c]) else float(a[y, c])) for f, a in frames.items() for y in range(40) for c in range(50)]
    cut = tiles.from_pixels(spark.createDataFrame(rows, "img string, frame string, y int, x int, v double"), ["img", "frame"], 16)
    got = {r.frame: r for r in restoration.refined_kernels(image, cut, ["img"], "frame", half).collect()}
    assert set(got) == set(kernels)
    for name, k in kernels.items():
        found = np.array(got[name].kernel).reshape(5, 5)
        assert np.abs(found - k).max() < 1e-4 and abs(found.sum() - 1) < 1e-9 and found.min() >= 0 and got[name].rounds < 2000 and got[name].residual < 1.0
