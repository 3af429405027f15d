import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.functions import curves
from photonframe.operators import kernels, register
from photonframe.sources import sidecar


def test_transforms_of_turned_and_mirrored_frames(spark):
    rng = np.random.default_rng(6)
    ref = rng.uniform(0, 400, (35, 2))
    flux = np.sort(rng.uniform(100, 1000, 35))[::-1]
    rows = []
    truth = {}
    for frame, (angle, flip) in enumerate([(0.02, 1), (1.3, 1), (0.5, -1)]):
        m = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]]) @ np.diag([1, flip])
        moved = (ref - [5, -8]) @ np.linalg.inv(m).T
        truth[frame] = m
        rows += [(frame, float(y), float(x), float(f)) for (x, y), f in zip(moved + rng.normal(0, 0.05, moved.shape), flux)][: 30 + frame]
    rows += [(9, float(y), float(x), float(f)) for (x, y), f in zip(rng.uniform(0, 400, (20, 2)), flux)]
    stars = spark.createDataFrame(rows, "frame int, y double, x double, flux double")
    target = spark.createDataFrame([(float(y), float(x), float(f)) for (x, y), f in zip(ref, flux)], "y double, x double, flux double")
    out = {r.frame: r for r in register.transforms(stars, target).collect()}
    for frame, m in truth.items():
        h = np.array(out[frame].hmat).reshape(3, 3)
        assert np.allclose(h[:2, :2], m, atol=2e-3) and np.allclose(h[:2, 2], [5, -8], atol=0.5) and out[frame].matched >= 25
    assert out[9].matched < 8


def test_psf_and_surface(spark):
    g = np.exp(-0.5 * (np.arange(-2, 3) / 0.8) ** 2)
    kernel = np.outer(g, g) / g.sum() ** 2
    rows = [("k", s, y - 2, x - 2, float(kernel[y, x] * (s + 1) * 10)) for s in range(7) for y in range(5) for x in range(5)]
    got = register.empirical_psf(spark.createDataFrame(rows, "k string, star_id int, dy int, dx int, v double"), ["k"]).collect()
    assert all(abs(r.v - kernel[r.dy + 2, r.dx + 2]) < 1e-9 for r in got) and len(got) == 25
    sky = [("k", float(x), float(y), 3 + 0.5 * x - 0.2 * y + 0.01 * x * y + (50 if (x, y) == (3, 3) else 0)) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(sky, "k string, x double, y double, v double")
    fit = df.join(register.surface_fit(df, ["k"]), "k").withColumn("s", register.surface_value("coefs"))
    assert max(abs(r.v - r.s) for r in fit.collect() if (r.x, r.y) != (3, 3)) < 1e-6


def test_matching_kernel_and_similarity():
    rng = np.random.default_rng(2)
    sharp = rng.normal(0, 10, (44, 44))
    k = rng.random((5, 5))
    seen = sum(k[i, j] * sharp[i : i + 40, j : j + 40] for i in range(5) for j in range(5)) + 3 + rng.normal(0, 0.1, (40, 40))
    got, offset, chi2 = kernels.matching_kernel(sharp, seen, np.full(seen.shape, 100.0), 2)
    assert np.allclose(got, k, atol=0.01) and abs(offset - 3) < 0.05 and 0.8 < chi2 < 1.2
    assert kernels.ssim(sharp, sharp, 50) == pytest.approx(1.0) and kernels.ssim(sharp, rng.normal(0, 10, sharp.shape), 50) < 0.3


def test_pictures_and_sidecars(spark, tmp_path):
    a = np.random.default_rng(1).random((4, 6, 3)).astype(np.float32)
    row = sidecar.pictures(spark.createDataFrame([("a", 4, 6, bytearray(a.tobytes()))], "name string, h int, w int, data binary")).first()
    assert row.png[:8] == b"\x89PNG\r\n\x1a\n" and row.png[16:24] == (6).to_bytes(4, "big") + (4).to_bytes(4, "big")
    at = row.png.index(b"IDAT")
    raw = np.frombuffer(zlib.decompress(row.png[at + 4 : at + 4 + int.from_bytes(row.png[at - 4 : at], "big")]), np.uint8).reshape(4, 19)[:, 1:].reshape(4, 6, 3)
    assert np.abs(raw / 255 - a).max() < 0.003
    df = spark.createDataFrame([(1.0, [1.0, float("nan")], {"x": float("inf")}, (float("nan"), "s"))], "a double, b array<double>, c map<string,double>, d struct<e:double,f:string>")
    sidecar.write_sidecars(df, str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").iterdir() if p.suffix == ".json")
    assert json.loads(text) == {"a": 1.0, "b": [1.0, None], "c": {"x": None}, "d": {"e": None, "f": "s"}}


def test_oklab_round_trip_and_gamut(spark):
    df = spark.createDataFrame([(r / 4, g / 4, b / 4) for r in range(5) for g in range(5) for b in range(5)], "r double, g double, b double")
    lab = curves.oklab(F.col("r"), F.col("g"), F.col("b"))
    out = df.select("r", "g", "b", *(c.alias(n) for c, n in zip(curves.oklab_to_rgb(*lab), "xyz"))).collect()
    assert all(abs(o.x - o.r) + abs(o.y - o.g) + abs(o.z - o.b) < 3e-3 for o in out)
    wild = spark.range(1).select(*(c.alias(n) for c, n in zip(curves.oklab_to_rgb(F.lit(0.7), F.lit(0.4), F.lit(0.1)), "xyz"))).select("x", "y", "z", *(c.alias(n) for c, n in zip(curves.oklab(F.col("x"), F.col("y"), F.col("z")), "lab"))).first()
    assert abs(wild.l - 0.7) < 0.01 and abs(np.arctan2(wild.b, wild.a) - np.arctan2(0.1, 0.4)) < 0.03
    a, b = curves.graded(F.lit(0.5), F.lit(0.1), F.lit(0.08), F.lit(1.0), warm=0.5, tint=1.0)
    got = spark.range(1).select(a.alias("a"), b.alias("b")).first()
    assert got.a > 0.15 and got.b > 0.11
