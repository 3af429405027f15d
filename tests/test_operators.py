"""Boundary cases of the operators on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.functions import curves, sky, text
from photonframe.operators import gates, jobs, lab, matching, pixels, robust, selection


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keep_percent(spark):
    cases = {0.1: 100, 0.5: 97, 1.0: 90, 1.5: 82.5, 2.0: 75, 3.0: 60, 10.0: 50}
    got = one(spark, *(selection.keep_percent(F.lit(s)) for s in cases))
    assert got == pytest.approx(tuple(cases.values()))


def frames(spark, n, **change):
    rows = [{"frame_id": i, "grp": "a", "registered": True, "nbstars": 50, "fwhm": 3.0 + i / 10, "wfwhm": 4.0 + i / 10, "roundness": 0.9, **{k: v for (j, k), v in change.get("at", {}).items() if j == i}} for i in range(n)]
    return spark.createDataFrame(rows, "frame_id long, grp string, registered boolean, nbstars int, fwhm double, wfwhm double, roundness double")


def test_selection_guards(spark):
    run = lambda df, s=2.0: {r.frame_id: list(r.reasons) for r in selection.select_frames(df, ["grp"], s).collect()}
    assert all(not r for r in run(frames(spark, 8)).values())
    ten = run(frames(spark, 10))
    assert [i for i, r in ten.items() if r] == [8, 9]
    odd = run(frames(spark, 14, at={(0, "fwhm"): 1.37, (1, "fwhm"): 0.0, (2, "nbstars"): 4, (3, "registered"): False, (4, "wfwhm"): None, (5, "roundness"): 0.1}))
    assert odd[0] == ["undersampled"] and odd[2] == ["few stars"] and odd[3] == ["not registered"] and odd[5] == ["elongated"]
    assert odd[4] == ["worse than the best share"] and odd[1] == []
    three = run(frames(spark, 14).withColumn("grp", F.col("frame_id").cast("string")))
    assert all(not r for r in three.values())


def test_overrides_and_weights(spark):
    df = selection.select_frames(frames(spark, 8, at={(3, "registered"): False}), ["grp"])
    chosen = spark.createDataFrame([(1, False), (3, True)], "frame_id long, keep boolean")
    out = {r.frame_id: r for r in selection.with_weights(selection.with_overrides(df, chosen)).collect()}
    assert not out[1].accepted and not out[3].accepted and out[0].weight == 1.0 and out[1].weight == 0.0 and out[2].weight == pytest.approx(4.0 / 4.2)


def test_ranges_and_names(spark):
    df = spark.createDataFrame([("k", i) for i in (5, 1, 2, 3, 9, 10)], "k string, i long")
    assert sorted((r.first, r.last) for r in matching.contiguous_ranges(df, ["k"], "i").collect()) == [(1, 3), (5, 5), (9, 10)]
    assert matching.contiguous_ranges(df.limit(0), ["k"], "i").count() == 0


def test_dark_match(spark):
    darks = spark.createDataFrame([(1, 15.0, 60.0, 1, 27.0, 3), (2, 15.0, 60.0, 1, 38.0, 20), (3, 30.0, 60.0, 1, 42.0, 9), (4, 60.0, 60.0, 1, 42.0, 9)], "dark_id int, d_exp double, d_gain double, d_bin int, d_temp double, d_stack int")
    lights = spark.createDataFrame([(1, 15.0, 60.0, 1, 42.0), (2, 15.0, 60.0, 1, 47.0), (3, 16.0, 60.0, 1, 47.0), (4, 15.0, None, 1, None)], "light_id int, l_exp double, l_gain double, l_bin int, l_temp double")
    out = {r.light_id: (r.dark_id, r.delta, r.warm) for r in matching.dark_masters(lights, darks).collect()}
    assert out[1] == (2, 4.0, False) and out[2] == (2, 9.0, True) and out[3] == (None, None, False) and out[4] == (2, 99.0, True)


def test_priority_and_nearest(spark):
    req = spark.createDataFrame([(i,) for i in range(4)], "r int")
    t = lambda *rows: spark.createDataFrame(list(rows), "r int, choice string")
    out = {x.r: (x.choice, x.level) for x in matching.by_priority(req, "r", t((0, "a")), t((0, "b"), (1, "b")), t((2, "c"))).collect()}
    assert out == {0: ("a", 0), 1: ("b", 1), 2: ("c", 2), 3: (None, None)}
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 10.0), (3, 10.4, 10.0)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 0.9, 0.0), (8, -0.9, 0.0), (9, 10.3, 10.0)], "rid int, rx double, ry double")
    near = matching.nearest_within(left, right, 1.0)
    assert {r.id: r.rid for r in near.collect()} == {1: 7, 2: 9, 3: 9}
    assert {r.id: r.rid for r in matching.one_to_one(near).collect()} == {1: 7, 3: 9}
    assert [r.id for r in matching.isolated(left, 1.0).collect()] == [1]


def test_crowded_fields(spark):
    """One cell holds most points; answers are those of every pair."""
    rng = random.Random(3)
    spot = lambda: (50 + rng.gauss(0, 0.05), 50 + rng.gauss(0, 0.05))
    wide = lambda: (rng.uniform(0, 100), rng.uniform(0, 100))
    ls = [(i, *(spot() if i % 3 else wide())) for i in range(400)] + [(400, None, 1.0), (401, 50.0, 50.0), (401, 90.0, 3.0), (None, 50.0, 50.0)]
    rs = [(i, *(spot() if i % 2 else wide())) for i in range(300)] + [(300, 50.0, 50.0), (301, 50.0, 50.0), (302, None, None)]
    left, right = spark.createDataFrame(ls, "id int, x double, y double"), spark.createDataFrame(rs, "rid int, rx double, ry double")
    far = lambda a, b: math.dist(a[1:], b[1:]) if None not in (*a[1:], *b[1:]) else math.inf
    want = {}
    for a in ls:
        near = [(d, b[0]) for b in rs if (d := far(a, b)) <= 2.0]
        want[a[0]] = min([*near, *([want[a[0]]] if want.get(a[0]) else [])], default=None) if a[0] is not None else None
    for limit in (1_000_000, 500):
        got = matching.nearest_within(left, right, 2.0, cell_pairs=limit).collect()
        assert len(got) == len(ls)
        for r in got:
            assert (want[r.id] is None and r.rid is None) or (r.rid == want[r.id][1] and r.dist == pytest.approx(want[r.id][0])), (limit, r)
    alone = sorted((str(a) for a in ls if a[0] is None or not any(b[0] is not None and b[0] != a[0] and far(a, b) <= 2.0 for b in ls)))
    assert sorted(str(tuple(r)) for r in matching.isolated(left, 2.0).collect()) == alone and len(alone) > 20
    assert matching.isolated(left.limit(0), 2.0).count() == matching.nearest_within(left.limit(0), right, 2.0).count() == 0


def test_curves(spark):
    x = F.lit(0.3)
    got = one(spark, curves.mtf(F.lit(0.2), 0.2), curves.mtf(x, 0.5), curves.star_midtone(5), curves.ghs(F.lit(0.0), 4.0, 2.0, 0.2), curves.ghs(F.lit(1.0), 4.0, 2.0, 0.2), curves.unscreen(curves.screen(x, F.lit(0.4)), F.lit(0.4)), curves.snr_ladder(F.lit(3.0), 0.2, 0.8), curves.snr_ladder(F.lit(99.0), 0.2, 0.8))
    assert got == pytest.approx((0.5, 0.3, 1 / 244, 0.0, 1.0, 0.3, 0.2, 0.8))
    steps = spark.range(101).select(curves.ghs(F.col("id") / 100, 6.0, 0.5, 0.3, 0.1, 0.9).alias("v")).collect()
    assert all(a.v <= b.v for a, b in zip(steps, steps[1:]))
    white = one(spark, *curves.oklab(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert white == pytest.approx((1.0, 0.0, 0.0), abs=1e-6)


def test_sky(spark):
    xi, eta = sky.gnomonic(F.lit(10.0), F.lit(20.5), F.lit(10.0), F.lit(20.0))
    back = sky.tangent_to_sky(F.lit(0.7), F.lit(-0.4), F.lit(10.0), F.lit(20.0))
    again = sky.gnomonic(*back, F.lit(10.0), F.lit(20.0))
    got = one(spark, xi, eta, *again, sky.decimal_year(F.lit("2026-07-02T12:00:00")), sky.separation(F.lit(0.0), F.lit(89.0), F.lit(180.0), F.lit(89.0)), sky.spectral_class(F.lit(5800)))
    assert got[:4] == pytest.approx((0.0, 0.5000127, 0.7, -0.4), abs=1e-6) and got[4] == pytest.approx(2026.5, abs=1e-3) and got[5] == pytest.approx(2.0) and got[6] == "G"


def test_text(spark):
    names = text.common_names(F.lit("M  31|NGC 224|NAME Andromeda|IC 1"))
    got = one(spark, text.norm(F.lit("Duo-Band! 2")), text.stage_key(F.lit("Frame 12 of 3.5 (x)")), text.shown(F.lit(1.0), F.lit(1.0004)), text.sexagesimal(F.lit(187.5)), names["messier"], names["ngc"], text.filter_code(F.lit("Duo-Band")), text.is_dualband(F.lit("L-eXtreme")), text.version_key(F.lit("v1.10.2")))
    assert got == ("duoband2", "Frame # of #", 4, "12h30m00.0s", "M 31", "NGC 224", 2, True, [1, 10, 2])


def test_gates(spark):
    rows = [(g, float(y), float(x), v, v, 0.0, 0.0) for g, v in (("ok", 0.10), ("dark", 0.079), ("bright", 0.121)) for y in range(24) for x in range(24)]
    df = spark.createDataFrame(rows, "pic string, y double, x double, lum double, top double, a double, b double")
    out = {r.pic: r for r in gates.summary(gates.with_verdicts(gates.measure(df, ["pic"])), ["pic"]).collect()}
    assert out["ok"].passed and out["ok"].failed == "" and out["dark"].failed == out["bright"].failed == "sky_median" and out["dark"].distance == pytest.approx(0.0125)
    few = gates.with_verdicts(gates.measure(df.filter("y < 5 and x < 5"), ["pic"])).filter("pic = 'ok' and gate = 'sky_median'").first()
    assert few.value is None and not few.passed
    stars = spark.createDataFrame([("stars_physical", None), ("stars_coloured", 0.05)], "gate string, value double")
    assert {r.gate: r.passed for r in gates.with_verdicts(stars).collect()} == {"stars_physical": True, "stars_coloured": False}


def test_trials(spark):
    rows = [("s", 0, 5.0, 1.0, 0.2), ("s", 1, 3.0, 2.0, float("nan")), ("s", 2, 4.0, 1.0, 0.2), ("s", 3, 4.0, 3.0, 0.1), ("t", 0, 1.0, 1.0, 0.9), ("t", 1, 9.0, 1.0, 0.6), ("t", 2, 8.0, 1.0, 0.6)]
    df = lab.with_violations(spark.createDataFrame(rows, "study string, n int, x double, y double, m double"), {"m": ("max", 0.5)})
    best = {r.study: r.n for r in lab.best_trial(df, ["study"], "x", True, "n").collect()}
    assert best == {"s": 2, "t": 2}
    assert df.filter("study = 's' and n = 1").first().violation == 1.0
    assert {(r.study, r.n) for r in lab.pareto_front(df, ["study"], "x", "y").collect()} == {("s", 1), ("s", 2), ("t", 0)}
    assert lab.grid(spark, {"a": (0, 1, 3), "b": (5, 5, 1), "c": (1, 2, 2)}).distinct().count() == 6
    assert lab.condition_holds([{"a": 1}, {"b": [2, 3]}], {"b": 3}) and not lab.condition_holds({"a": 1, "b": 2}, {"a": 1})


def test_sampler_finds_the_minimum():
    es = lab.OnePlusOne(2, seed=4)
    for _ in range(400):
        x = es.ask()
        bad = (0,) if x[0] < 0.3 else ()
        es.tell(x, float(((x - [0.1, 0.7]) ** 2).sum()), bad)
    assert abs(es.mean[0] - 0.3) < 0.05 and abs(es.mean[1] - 0.7) < 0.05


def test_jobs(spark):
    df = spark.createDataFrame([("q", 1, True, 10.0), ("q", 2, False, None), ("q", 3, False, 5.0)], "k string, n int, run boolean, eta double")
    assert [(r.n, r.place, r.starts_in) for r in jobs.queue(df, ["k"], "run", "n", "eta").orderBy("n").collect()] == [(1, 1, 0.0), (2, 2, 10.0), (3, 3, None)]
    assert one(spark, *jobs.eta(F.lit(0.5), F.lit(10.0), F.lit(30.0)), *jobs.eta(F.lit(0.01), F.lit(10.0), F.lit(5.0)), jobs.active_seconds(F.lit(5.0), F.lit(None).cast("double"), F.lit(2.0), F.lit(20.0))) == (10.0, 20.0, None, 0.0, 13.0)


def test_robust(spark):
    spike = [("a", float(v)) for v in range(1000, 60000, 59)] + [("a", 60000.0)] * 400 + [("b", float(v)) for v in range(1, 500)]
    df = spark.createDataFrame(spike, "k string, v double")
    assert {r.k: r.plateau for r in robust.plateau(df, ["k"], "v").collect()} == {"a": 60000.0, "b": None}
    bars = spark.createDataFrame([("k", r, 100.0 + (8 if r % 2 else 0)) for r in range(60)], "k string, r long, m double").withColumn("s", F.lit(2.0))
    assert robust.banding(bars, ["k"], "r", "m", "s", 400).first().banded
    w = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 1.0), ("k", 3.0, 5.0)], "k string, v double, w double")
    assert robust.weighted_median(w, ["k"], "v", "w").first().wmedian == 3.0


def test_hdr_uses_the_short_exposure_in_the_core(spark):
    rows = [("sky", t, 20.0 * t) for t in (1.0, 10.0, 60.0)] + [("core", t, min(60000.0, 4000.0 * t)) for t in (1.0, 10.0, 60.0)]
    df = spark.createDataFrame(rows, "px string, t double, v double")
    out = {r.px: r.blended for r in pixels.hdr_blend(df, ["px"], "t", "v", F.lit(True), 1 + 0.5 * F.col("v"), 60000.0).collect()}
    assert out["sky"] == pytest.approx(20.0) and out["core"] == pytest.approx(4000.0)


def test_shift_and_hue(spark):
    rng = [(y, x, math.sin(y * 1.7) + math.cos(x * 2.3 + y)) for y in range(12) for x in range(12)]
    a = spark.createDataFrame([("k", *r) for r in rng], "k string, y int, x int, v double")
    b = a.select("k", (F.col("y") + 2).alias("y"), (F.col("x") - 1).alias("x"), (F.col("v") * 3 + 1).alias("v"))
    r = pixels.integer_shift(a, b, ["k"], 3).first()
    assert (r.dy, r.dx) == (2, -1) and r.corr == pytest.approx(1.0)
    # Several tiles, gaps on both sides, an image of another key that does not vary.
    rng_ = random.Random(5)
    field = {(y, x): rng_.random() for y in range(44) for x in range(50)}
    a = spark.createDataFrame([("p", y, x, v) for (y, x), v in field.items() if (y * 50 + x) % 11] + [("q", y, x, 1.0) for y in range(4) for x in range(4)], "k string, y int, x int, v double")
    b = spark.createDataFrame([("p", y - 4, x + 3, 5000 - v) if (y + x) % 2 else ("p", y - 4, x + 3, 5000 + 9 * v) for (y, x), v in field.items() if y >= 4 and (y * 50 + x) % 7] + [("q", y, x, 1.0 * y) for y in range(4) for x in range(4)], "k string, y int, x int, v double")
    got = pixels.integer_shift(a, b, ["k"], 5, 16).collect()
    both = {r[1:3]: r[3] for r in b.filter("k = 'p'").collect()}
    pairs = [(v, both[y - 4, x + 3]) for (y, x), v in field.items() if (y * 50 + x) % 11 and (y - 4, x + 3) in both]
    assert [(r.k, r.dy, r.dx) for r in got] == [("p", -4, 3)] and got[0].corr == pytest.approx(np.corrcoef(np.array(pairs).T)[0, 1], abs=1e-6)
    h = lambda b_: spark.createDataFrame([("k", b_, 1.0)], "k string, bin int, share double")
    assert pixels.hue_distance(h(0), h(17), ["k"]).first().distance == pytest.approx(1 / 9)
    assert pixels.hue_distance(h(0), h(9), ["k"]).first().distance == pytest.approx(1.0)
    raw = spark.createDataFrame([("k", y, x, float(10 * (y % 2) + x % 2)) for y in range(4) for x in range(4)], "k string, y int, x int, v double")
    assert {(r.r, r.g, r.b) for r in pixels.superpixels(raw, ["k"], "y", "x", "v", "RGGB").collect()} == {(0.0, 5.5, 11.0)}
