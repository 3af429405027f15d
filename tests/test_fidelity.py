import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import fidelity, tiles


def windows(a):
    """Weighted window means of whole windows, pixel by pixel."""
    g = np.array([math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)])
    w = np.outer(g, g) / g.sum() ** 2
    return np.array([[(w * a[y : y + 11, x : x + 11]).sum() for x in range(a.shape[1] - 10)] for y in range(a.shape[0] - 10)])


def half(a):
    y, x = (np.arange(0, n, 2) for n in a.shape)
    b, c = np.maximum(y - 1, 0), np.maximum(x - 1, 0)
    return (a[np.ix_(y, x)] + a[np.ix_(b, x)] + a[np.ix_(y, c)] + a[np.ix_(b, c)]) / 4


def cdf(v):
    return np.vectorize(lambda t: float(t > 0) if abs(t) >= 6 else 0.5 * (1 + math.erf(t / math.sqrt(2))))(v)


def whole(source, finished, scales):
    """The measure on whole images."""
    a, b, out = (source - source.min()) * (2.0**32 - 1) / (source.max() - source.min()), finished * 255, []
    g = np.array([math.exp(-((i - 5) ** 2) / 4.5) for i in range(11)])
    effective = 1 / ((np.outer(g, g) / g.sum() ** 2) ** 2).sum()
    for scale in range(scales):
        if min(a.shape) < 11:
            out.append((None, None, None))
            continue
        ma, mb = windows(a), windows(b)
        sa, sb = np.sqrt(np.maximum(windows(a * a) - ma * ma, 0)), np.sqrt(np.maximum(windows(b * b) - mb * mb, 0))
        like = (windows(a * b) - ma * mb + 10) / (sa * sb + 10)
        d = lambda v: v[:-2] - 2 * v[1:-1] + v[2:]
        u = math.sqrt(math.pi / 2) / 6 * np.abs(d(d(a).T)).mean() * (1 + 3 / math.sqrt(2 * effective))
        f = 0.114 * 16 / 2**scale
        t = 128 / (1.4 * 260 * (0.0192 + f) * math.exp(-(f**1.1)))
        p, q = cdf((sa - u) / (u / 3)), cdf((sb - t) / (t / 3))
        hit = (p * q * np.clip(like, 0, 1)).sum() / p.sum()
        out.append((hit, ((2 * p * q + 0.01) / (p * p + q * q + 0.01) * like).mean(), hit - ((1 - p) * q).sum() / max((1 - p).sum(), 1e-9)))
        a, b = half(a), half(b)
    return out


def table(spark, images):
    rows = [(k, y, x, float(s[y, x]), float(f[y, x])) for k, (s, f) in images.items() for y in range(s.shape[0]) for x in range(s.shape[1])]
    return spark.createDataFrame(rows, "k string, y int, x int, v double, f double")


def scene(seed, shape):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[: shape[0], : shape[1]]
    s = (1000 + 200 * np.sin(x / 9.0) * np.cos(y / 13.0) + 400 * (y // 20 % 2) + rng.normal(0, 60, shape)).astype(np.float32).astype(float)
    return s, np.clip((s - 300) / 1500, 0, 1).astype(np.float32).astype(float)


def test_equals_whole_images(spark):
    images = {"a": scene(1, (75, 61)), "b": scene(2, (24, 90)), "c": scene(3, (8, 9))}
    df = table(spark, images)
    got = fidelity.fidelity(tiles.from_pixels(df, ["k"], 32, second="f"), ["k"], 3)
    rows = {(r.k, r.scale): (r.hits, r.tmqi, r.youden) for r in got.collect()}
    assert len(rows) == 9
    for k, (s, f) in images.items():
        for scale, want in enumerate(whole(s, f, 3)):
            assert rows[k, scale] == (pytest.approx(want, abs=1e-5) if want[0] is not None else want), (k, scale)
    scores = {r.k: r.score for r in fidelity.score(got, ["k"]).collect()}
    w = np.array(fidelity.WEIGHTS)
    assert scores["c"] is None and scores["a"] == pytest.approx(sum(w[i] * rows["a", i][0] for i in range(3)) / w[:3].sum() * w.sum())
    product = {r.k: r.score for r in fidelity.score(got, ["k"], "tmqi").collect()}
    assert product["a"] == pytest.approx(math.exp(sum(w[i] * math.log(rows["a", i][1]) for i in range(3)) / w[:3].sum() * w.sum()))


def test_five_scales_over_several_tiles(spark):
    s, f = scene(4, (230, 205))
    df = table(spark, {"a": (s, f)})
    rows = {r.scale: (r.hits, r.tmqi, r.youden) for r in fidelity.fidelity(tiles.from_pixels(df, ["k"], 96, second="f"), ["k"]).collect()}
    for scale, want in enumerate(whole(s, f, 5)):
        assert rows[scale] == pytest.approx(want, abs=1e-5), scale


def test_gaps_flat_images_and_noise_of_others(spark):
    s, f = scene(5, (40, 40))
    df = table(spark, {"gap": (s, f), "flat": (np.full((20, 20), 7.0), np.full((20, 20), 0.5)), "faint": (s, np.full(s.shape, 0.5))})
    df = df.filter("k != 'gap' or not (y = 20 and x = 20)").withColumn("f", F.when(~((F.col("k") == "gap") & (F.col("y") == 3) & (F.col("x") == 3)), F.col("f")))
    pairs = tiles.from_pixels(df, ["k"], 64, second="f")
    counts = {(r.k, r.scale): r.n for r in fidelity.measures(pairs, ["k"], 2).collect()}
    assert counts["gap", 0] == 30 * 30 - 121 - 16 and counts["flat", 0] == 100 and counts["flat", 1] == 0
    levels = {(r.k, r.scale): r for r in fidelity.fidelity(pairs, ["k"], 2).collect()}
    assert levels["flat", 0].hits == pytest.approx(0.0013498980316) and levels["flat", 1].hits is None
    assert levels["faint", 0].hits < 0.01 < levels["gap", 0].hits
    loud = fidelity.noise(fidelity.measures(pairs, ["k"], 2), ["k"]).withColumn("sigma", F.col("sigma") * 1000)
    assert {r.hits for r in fidelity.fidelity(pairs, ["k"], 2, loud).filter("k = 'faint'").collect()} != {levels["faint", 0].hits}
    assert fidelity.fidelity(pairs.limit(0), ["k"], 2).count() == 0
    with pytest.raises(ValueError):
        fidelity.fidelity(pairs, ["k"], 6)


def test_normal_cdf():
    x = np.linspace(-6.5, 6.5, 131)
    assert np.abs(fidelity.normal_cdf(x) - cdf(x)).max() < 1e-11


def test_ragged_images_equal_sql(spark, tmp_path):
    """A last row of half the columns, and rows and columns apart from the rest, move the last row and column of coarser scales."""
    import duckdb

    from photonframe.plans import registry

    from .oracle import compare

    place = lambda i, y, x: i * 128 * 128 + y * 128 + x
    keys = [place(0, y, x) for y in range(41) for x in range(128) if y < 40 or x < 64]
    keys += [place(1, y, x) for y in range(95) for x in range(128) if y <= 49 or (y == 94 and x < 50) or (y == 93 and x == 127)]
    df = spark.createDataFrame([(k, 1000.0 + (k * 7919 % 4990) * 100.0 % 400_000) for k in keys], "o_orderkey long, o_totalprice double")
    df.write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert compare(spark, con, str(tmp_path), registry.QUERIES["structural_fidelity"], registry.ORACLES["structural_fidelity"]) == 8
