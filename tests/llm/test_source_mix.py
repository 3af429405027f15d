import random
from fractions import Fraction

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from photonframe.llm import source_mix as sm

from .util import WORD


def brute_targets(sizes, weights):
    """Water filling by bisection on the level."""
    total, lo, hi = 1.5 * sum(sizes), 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * w, 2 * s) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(hi * w, 2 * s) for s, w in zip(sizes, weights)]


def checked(got, texts, sources):
    names = sorted(set(sources), key=lambda s: (s is None, s or ""))
    sizes = {n: sum(len(WORD.findall(t or "")) for t, s in zip(texts, sources) if s == n) for n in names}
    want = dict(zip(names, brute_targets(list(sizes.values()), [(5, 2, 1)[i % 3] for i in range(len(names))])))
    took, longest = dict.fromkeys(names, 0), dict.fromkeys(names, 0)
    for r, t, s in zip(got, texts, sources, strict=True):
        assert r.size == len(WORD.findall(t or "")) and r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        took[s] += r.taken
        longest[s] = max(longest[s], r.size)
    assert all(abs(took[n] - want[n]) <= longest[n] + 1 for n in names)


def test_targets():
    rng = random.Random(2)
    for _ in range(100):
        sizes = [rng.randint(0, 1000) for _ in range(rng.randint(1, 8))]
        weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        for a, b in zip(sm.targets(sizes, weights, Fraction(3, 2) * sum(sizes), 2), brute_targets(sizes, weights), strict=True):
            assert abs(float(a) - b) < 1e-6 * max(1, sum(sizes))


def test_route_against_all_splits():
    """Least cost at greatest flow, against trying every amount."""
    from itertools import product

    rng = random.Random(8)
    for _ in range(60):
        k = rng.randint(1, 3)
        patterns = [(tuple(sorted(rng.sample(range(k), rng.randint(1, k)))), rng.randint(0, 3)) for _ in range(rng.randint(1, 3))]
        quotas = [rng.randint(0, 6) for _ in range(k)]

        def fits(amounts):
            left = {tuple(quotas)}
            for (members, _), a in zip(patterns, amounts):
                for _ in range(a):
                    left = {q[:s] + (q[s] - 1,) + q[s + 1 :] for q in left for s in members if q[s] > 0}
            return bool(left)

        cost = lambda t, s: sum((u - 1) * max(0, min(t, u * s) - (u - 1) * s) for u in (1, 2))
        best = min((-sum(a), sum(cost(t, s) for t, (_, s) in zip(a, patterns))) for a in product(*(range(2 * s + 1) for _, s in patterns)) if fits(a))
        got = sm.route(patterns, quotas, 2)
        assert fits(got) and (-sum(got), sum(cost(t, s) for t, (_, s) in zip(got, patterns))) == best


def test_mix_and_reruns(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one"] + [" ".join("w" for _ in range(rng.choice([1, 5, 30, 400]))) for _ in range(600)]
    sources = [rng.choice(["b", "b", "b", "a", "é", "z", None]) for _ in texts]
    df = spark.createDataFrame([(i, t, s, 7, "x") for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string, size int, target string")
    first = sorted(sm.mix(df).collect(), key=lambda r: r.doc_id)
    checked(first, texts, sources)
    assert first == sorted(sm.mix(df.repartition(7)).collect(), key=lambda r: r.doc_id)
    assert sm.mix(df.limit(0)).count() == 0
    repeated = sm.mix(spark.createDataFrame([(None, "a b", "s"), (None, "a b", "s"), (1, None, None)], "doc_id long, text string, source string")).collect()
    assert len(repeated) == 3 and all(r.taken <= 2 * r.size for r in repeated)


def test_repeated_and_null_ids_at_the_cut(spark):
    """Rows equal in id and size are parted so that the sum is nearest to the target."""
    for ids in ([7] * 400, [None] * 400, [None] * 200 + [3] * 200, [i % 5 for i in range(400)]):
        rows = [(i, "w w w", "s") for i in ids] + [(None, None, "s"), (8, "", None), (1000, "w " * 50, "t")]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
        got = sm.mix(df).collect()
        own = [r for r in got if r.size == 3]
        assert len(got) == len(rows) and all(r.taken in (0, 3, 6) for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1.5
        again = sm.mix(df.repartition(3)).collect()
        count = lambda rows: sorted(((r.doc_id, r.size, r.taken) for r in rows), key=str)
        assert count(got) == count(again)
        whole = sm.repeated(df)
        assert whole.columns == df.columns and whole.filter("text = 'w w w'").count() == sum(r.taken for r in own) // 3


def test_many_patterns_are_routed_quickly():
    rng = random.Random(4)
    patterns = [(tuple(sorted(rng.sample(range(40), rng.randint(1, 5)))), rng.randint(1, 1000)) for _ in range(8000)]
    total = sum(s for _, s in patterns)
    for quotas in ([total // 400] * 40, [total // 10] * 4 + [0] * 36):
        taken = sm.route(patterns, quotas, 2)
        assert all(t <= 2 * s for t, (_, s) in zip(taken, patterns)) and sum(taken) <= sum(quotas)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate([["a"], ["a", "b"], ["b"], ["a", None], ["b", "a"]] * 40)]
    got = sm.mix(spark.createDataFrame(rows, "doc_id long, text string, s array<string>"), sources=F.col("s")).collect()
    assert all(r.taken in (0, 10, 20) for r in got)
    assert abs(sum(r.taken for r in got) - 1.5 * 2000) < 1000


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    docs = sorted(pq.read_table(f"{sf_dir}/documents.parquet").to_pylist(), key=lambda d: d["doc_id"])
    got = sorted(QUERIES["op3_source_mix"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d["doc_id"] for d in docs]
    checked(got, [d["text"] for d in docs], [d["source"] for d in docs])
