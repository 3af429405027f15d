import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from photonframe.llm import ngram_join as nj

from .util import components, near_copies, shingles

ODD = [None, "", "   \n", "one", "One", "two words", "a b c", "a b c d", "A B C D", "x " * 50, "é ü é ü", "É ü é ü", "long " * 20000]


def run(spark, texts, n, similarity):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string, g long").repartition(3)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_classes(df, n, similarity).collect()}


@pytest.mark.parametrize(("n", "similarity", "seed"), [(4, (85, 100), 1), (5, (80, 100), 2), (2, (60, 100), 3)])
def test_against_brute_force(spark, n, similarity, seed):
    texts = near_copies(seed) + ODD
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    want = components(list(sets), sets, *similarity)
    assert run(spark, texts, n, similarity) == {i: (len(sets[i]), want[i]) for i in sets}


def test_blocks_and_seeds_change_nothing(spark, monkeypatch):
    texts = near_copies(5, families=2, members=60, words=40)
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    want = components(list(sets), sets, 85, 100)
    monkeypatch.setattr(nj, "BLOCK", 7)
    monkeypatch.setattr(nj, "SAMPLE", 2)
    assert {i: c for i, (_, c) in run(spark, texts, 4, (85, 100)).items()} == want


def test_many_keys_are_sorted_in_small_tasks_and_read_no_more_than_needed(spark, monkeypatch):
    """More keys than the session's partitions hold are dealt over more tasks; only steps that spread keys out read them."""
    texts = near_copies(5, families=2, members=20, words=40)
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    plans, plain = {}, nj.saved

    def saved(df, name="stage", replaces=()):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, replaces)

    monkeypatch.setattr(nj, "saved", saved)
    few = run(spark, texts, 4, (85, 100))
    assert "REPARTITION_BY_NUM" not in plans["stars"]
    assert {name for name, plan in plans.items() if "keys:binary" in plan} <= {"shingles", "counts", "stars"}
    plans.clear()
    lows, highs = nj.bands(85, 100)
    distinct = {frozenset(s): t for s, t in zip(sets.values(), texts, strict=True)}.values()
    keys = sum(len(nj.keys_of(s, 85, 100, lows, highs)) for s in nj.shingle_sets(pa.array(list(distinct)), 4))
    monkeypatch.setattr(nj, "TASK_KEYS", 20)
    assert run(spark, texts, 4, (85, 100)) == few == {i: (len(sets[i]), c) for i, c in components(list(sets), sets, 85, 100).items()}
    parts = [int(n) for n in re.findall(r"hashpartitioning\(key#\d+L?, salt#\d+, (\d+)\)", plans["stars"])]
    assert parts == [-(-keys // 20)] and parts[0] > 4


def test_every_linked_pair_shares_a_key():
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        lows, highs = nj.bands(num, den)
        for _ in range(300):
            size = int(rng.integers(lows[0], 300))
            pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
            a = np.unique(pool[:size])
            drop = int(rng.integers(0, len(a) * (den - num) // (den + num) + 1))
            b = np.unique(np.concatenate((a[drop:], pool[size : size + drop])))
            both = len(np.intersect1d(a, b))
            if den * both >= num * (len(a) + len(b) - both) and len(a) != both:
                assert np.intersect1d(nj.keys_of(a, num, den, lows, highs), nj.keys_of(b, num, den, lows, highs)).size


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.ngram_classes(empty, 4, (85, 100)).count() == 0
    rows = [(None, "a b c d e"), (None, "z"), (3, "a b c d e"), (3, "a b c d e"), (4, "A b c d e")]
    got = sorted(map(tuple, nj.ngram_classes(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()), key=str)
    assert got == sorted([(None, 2, 3), (None, 1, None), (3, 2, 3), (3, 2, 3), (4, 2, 3)], key=str)


def test_repeated_and_null_ids_lose_no_link(spark):
    """Rows are nodes: ids, repeated or null, neither join nor part texts."""
    rng = np.random.default_rng(8)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 500, 120)) for _ in range(2))
    near = b + " end"
    for other in (5, 6, None):
        rows = [(1, a), (5, a), (other, b), (2, near), (None, near + " now"), (9, None), (9, "one"), (9, None)] + [(other, b)] * 30
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in nj.ngram_classes(df, 4, (85, 100)).collect()}
        assert got == {(1, 117, 1), (5, 117, 1), (other, 117, 2), (2, 118, 2), (None, 119, 2), (9, 0, 9), (9, 1, 9)}
    texts = near_copies(11, families=4, members=10)
    ids = [None if i % 7 == 0 else i % 13 for i in range(len(texts))]
    sets = {i: shingles(t, 4) for i, t in enumerate(texts)}
    group = components(list(sets), sets, 85, 100)
    low = {}
    for i, g in group.items():
        low[g] = min((x for x in (low.get(g), ids[i]) if x is not None), default=None)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted(map(str, nj.ngram_classes(df, 4, (85, 100)).collect()))
    want = spark.createDataFrame([(ids[i], len(sets[i]), low[group[i]]) for i in sets], "doc_id long, n_shingles long, component_id long")
    assert got == sorted(map(str, want.collect()))


def test_one_of_each_group_stays(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(60))
    near = {x: f"{t} end" for x, t in (("a", a), ("b", b))}
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (6, near["b"], "x"), (None, near["a"], "x"), (7, None, "x"), (7, None, "x"), (7, "", "y"), (8, "one", "x"), (8, "one", "x"), (8, "two", "x"), (None, "lone", "x"), (None, "lone", "x"), (None, "lone Lone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    got = nj.one_of_each(df, 4, (85, 100))
    assert got.columns == df.columns
    want = [(1, a), (5, b), (7, None), (7, None), (7, ""), (8, "one"), (8, "two"), (None, "lone"), (None, "lone Lone")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    same = [(4, a, "x"), (4, near["a"], "x"), (None, b, "x"), (None, near["b"], "x"), (None, near["b"], "z")]
    left = nj.one_of_each(spark.createDataFrame(same, "doc_id long, text string, h string"), 4, (85, 100)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in left) == [("4", "w"), ("None", "v")]
    assert nj.one_of_each(df.limit(0)).count() == 0


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    sets = {d["doc_id"]: shingles(d["text"], 4) for d in docs}
    want = components(sorted(sets), sets, 85, 100)
    got = QUERIES["op4_ngram_jaccard_join"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), want[i]) for i, s in sets.items()}
