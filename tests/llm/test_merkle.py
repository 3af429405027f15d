import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from photonframe.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """All levels, and of every node the (sibling, left) pairs up to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([h(*x[i : i + 2]) for i in range(0, len(x), 2)])
    paths = []
    for i in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            j = i ^ 1
            path.append((level[j] if j < len(level) else None, i % 2 == 1))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    """(doc_id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted(((r[0], leaf(r)) for r in rows if r[2] == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1])) for g in langs}
    trees = {g: tree([x[1] for x in groups[g]]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    return [(i, d, trees[g][0], root, tuple(p + tops[k])) for k, g in enumerate(langs) for (i, d), p in zip(groups[g], trees[g][1], strict=True)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int"


def odd_rows():
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(-20, 300)]), rng.choice(["a", None, "é"]), rng.choice([None, "", "de", "en", "en", "en", "z", "é", "漢"]), rng.choice([None, 3, -7]), rng.choice([None, "", "text", "x" * 9000, "naïve 🙂"])) for _ in range(700)]
    return rows + [(7, "s", "en", 1, "same")] * 150 + [(None, None, "solo", None, None)]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_odd_tables(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    monkeypatch.setattr(merkle, "BLOCK", 1 << bits)
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    out = merkle.manifest(df, "doc_id", "lang", merkle.document_leaf(F.col("n_chars")), {"n": F.lit(1)})
    assert out.columns == ["doc_id", "lang", "leaf", "n", "subroot", "root", "path"]
    got = out.withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((x.s, x.left) for x in r.path)) for r in got) == Counter(plain(rows))
    assert all(r.again == r.root for r in got)


def test_one_group_one_row_no_row(spark):
    for rows in ([(1, "s", "en", 1, "a")], [(i, "s", None, 1, "a") for i in range(5)], []):
        df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
        got = merkle.manifest(df, "doc_id", "lang", merkle.document_leaf(F.col("n_chars"))).collect()
        assert sorted((r.doc_id, r.leaf, r.subroot, r.root, tuple((x.s, x.left) for x in r.path)) for r in got) == (sorted(plain(rows)) if rows else [])


def test_groups_with_many_places_are_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", 0)
    rows = [(i, "s", f"l{i % 90}", i, "t") for i in range(400)]
    df = spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)
    got = merkle.manifest(df, "doc_id", "lang", merkle.document_leaf(F.col("n_chars"))).collect()
    assert Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((x.s, x.left) for x in r.path)) for r in got) == Counter(plain(rows))


def test_tampered_rows_do_not_verify(spark, sf_dir):
    import zlib

    from photonframe.llm.queries import QUERIES

    got = QUERIES["op13_merkle_manifest"](spark, sf_dir).collect()
    assert got and all(r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0) == (r.folded_root == r.root) for r in got)
