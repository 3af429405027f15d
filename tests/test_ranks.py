import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonframe.operators import ranks, robust


def table(spark, seed, n=3000):
    rng = random.Random(seed)
    draw = {"a": lambda: rng.gauss(0, 1), "b": lambda: float(rng.randint(0, 5)), "c": lambda: rng.lognormvariate(0, 4), None: lambda: rng.choice([math.inf, -math.inf, 1.5, 2.5])}
    keys = rng.choices(["a", "b", "c", None, "one"], [10, 10, 10, 2, 0.01], k=n)
    rows = [(k, None if rng.random() < 0.05 else draw.get(k, lambda: 7.0)(), i) for i, k in enumerate(keys)] + [("empty", None, n)]
    return rows, spark.createDataFrame(rows, "k string, v double, i long").repartition(5)


@pytest.mark.parametrize("accuracy, most", [(40, 0), (400, 0), (10_000, 0), (40, 500_000)])
def test_quantiles_are_exact_whatever_the_accuracy(spark, monkeypatch, accuracy, most):
    monkeypatch.setattr(ranks, "GROUP_ROWS", most)
    rows, df = table(spark, accuracy)
    wanted = {"q0": 0.0, "q25": 0.25, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    got = {r.k: r for r in ranks.quantiles(df, ["k"], "v", wanted, accuracy).collect()}
    want = {}
    for k, v, _ in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n == len(v)
        ordered = sorted(v)
        for name, q in wanted.items():
            at = (len(v) - 1) * q
            low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
            if math.isfinite(low) and math.isfinite(high):
                assert math.isclose(got[k][name], low + (at - math.floor(at)) * (high - low), rel_tol=1e-12, abs_tol=1e-12)
    whole = ranks.quantiles(df.filter("k = 'a'"), [], "v", {"m": 0.5}, accuracy).first()
    assert math.isclose(whole.m, float(np.median(want["a"])), abs_tol=1e-12)
    assert ranks.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}, accuracy).count() == 0


@pytest.mark.parametrize("most", [0, 500_000])
def test_ranks_and_parts(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    monkeypatch.setattr(ranks, "GROUP_ROWS", most)
    rows, df = table(spark, 7)
    got = ranks.ranked(df, ["k"], "v", "i").withColumn("part", ranks.ntile(F.col("rank"), F.col("n"), 7)).collect()
    groups = {}
    for k, v, i in rows:
        groups.setdefault(k, []).append((v is not None, v or 0.0, i))
    assert len(got) == len(rows)
    place = {(k, i): (at + 1, len(g)) for k, g in groups.items() for at, (_, _, i) in enumerate(sorted(g))}
    for r in got:
        assert (r.rank, r.n) == place[r.k, r.i]
        small, larger = divmod(r.n, 7)
        sizes = [small + (j < larger) for j in range(7)]
        assert r.part == next(j for j in range(7) if r.rank <= sum(sizes[: j + 1])) + 1


@pytest.mark.parametrize("most", [0, 500_000])
def test_moving_average_over_cells(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "ACCURACY", 50)
    monkeypatch.setattr(ranks, "GROUP_ROWS", most)
    rng = random.Random(3)
    rows = [("ab"[i % 2], rng.random(), rng.randint(0, 900), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v double, t long, i long")
    real = ranks.neighbours
    monkeypatch.setattr(ranks, "neighbours", lambda df, keys, rank, half: real(df, keys, rank, half, cell=16))
    got = {r.i: r.smooth for r in robust.moving_average(df, ["k"], "v", 6, "t", "i").collect()}
    assert len(got) == len(rows)
    for key in "ab":
        mine = sorted((t, i, v) for k, v, t, i in rows if k == key)
        for at, (_, i, _) in enumerate(mine):
            near = [v for _, _, v in mine[max(0, at - 6) : at + 7]]
            assert math.isclose(got[i], sum(near) / len(near), rel_tol=1e-9)


def test_large_and_small_groups_give_the_same(spark, monkeypatch, sf_dir):
    from photonframe.plans import registry

    for name in ("frame_selection", "noise_model_fit", "mad_sigma", "object_snr", "quantile_levels", "saturation_plateau"):
        got = []
        for most in (0, 500_000):
            monkeypatch.setattr(ranks, "GROUP_ROWS", most)
            got.append(sorted(map(str, registry.QUERIES[name](spark, sf_dir).collect())))
        assert got[0] == got[1], name
