import random
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from photonframe.llm import histogram_shards as hs


def checked(got, texts, shards, slack):
    assert len(got) == len(texts)
    size, rows = Counter(), Counter()
    slots = {}
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t)) and 0 <= r.shard < shards
        size[r.shard] += r.size
        rows[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / shards, max(r.size for r in got)
    assert all(abs(size[s] - mean) <= 2 * max(largest, slack * mean) for s in range(shards))


@pytest.mark.parametrize("copies", [1, 900])
def test_near_equal_and_rerun(spark, copies):
    rng = random.Random(copies)
    texts = [None, "", "é"] + ["x" * rng.choice([3, 40, 700]) + str(i) for i in range(1500)] + ["same text " * 30] * copies
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id long, text string, size int, shard string")
    got = sorted(hs.histogram_shards(df, 24).collect())
    checked(got, texts, 24, 0.005)
    assert got == sorted(hs.histogram_shards(df.repartition(5), 24).collect())


@pytest.mark.parametrize("same", [(7, "a text of many rows"), (None, None), (3, "")])
def test_rows_equal_in_id_and_text_part_by_bytes(spark, same):
    """Against a plain deal: half of all rows are one row; shards stay equal, all others stay with their like."""
    rng = random.Random(4)
    rows = [(i + 10, "y" * rng.choice([3, 40, 200]) + str(i // 3)) for i in range(3000)] + [same] * 3000
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = hs.histogram_shards(df, 24, tolerance=0.05).collect()
    sizes, slots, where = Counter(), {}, {}
    for r in got:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and all(abs(b - mean) <= 2 * (0.05 * mean + 211) for b in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    apart = [g for g, shards in where.items() if len(shards) > 1]
    assert len(apart) <= 24 and all(g == (zlib.crc32((same[1] or "").encode()), len((same[1] or "").encode()) + 8) for g in apart)
    again = hs.histogram_shards(df.repartition(3), 24, tolerance=0.05).collect()
    assert Counter(again) == Counter(got)
    kept = hs.histogram_shards(df.withColumn("extra", F.lit("e")), 24, keep=("extra",), tolerance=0.05).drop("extra").collect()
    assert Counter(kept) == Counter(got)


def test_equal_texts_stay_together_while_they_fit(spark):
    rows = [(i, f"text {i // 4}") for i in range(4000)]
    where = {}
    for r in hs.histogram_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24, tolerance=0.05).collect():
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hs.histogram_shards(empty, 4).count() == 0
    one = hs.histogram_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 4).collect()
    assert [(r.slot, r.size) for r in one] == [(0, 9)]
    same = hs.histogram_shards(spark.createDataFrame([(None, "a")] * 10, "doc_id long, text string"), 4).collect()
    # Equal rows part, so that shards stay equal.
    assert sorted(Counter(r.shard for r in same).values()) == [2, 2, 3, 3] and sorted(r.slot for r in same) == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}" * (i % 7), "x", "y") for i in range(300)], "doc_id long, text string, lang string, slot string")
    hs.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(back) == 300 and {(r.doc_id, r.text, r.lang) for r in back} == {(r.doc_id, r.text, r.lang) for r in df.collect()}


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = QUERIES["op9_histogram_shards"](spark, sf_dir).collect()
    checked(got, texts, 24, 0.005)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
