import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from photonframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n  x", "  two  spaces ", "don't WE'LL we'll", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|",
    "x" * 5000, "ab " * 3000, " 　  y", "\x1c\x1f a", "½²Ⅷ 12,5", "é" * 300, "漢字かな交じり文", "🙂🙃" * 20, "é ​﻿", "\x00\x01", "\U000e0001",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_same_ids_and_text_as_the_library(tokenizer):
    rng = random.Random(7)
    alphabet = "abc ABC\n\t '.,123éßñ漢🙂  stre"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    with open(PATH, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    packed = vocabulary.encode(texts)
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [w.ids for w in want]
    assert vocabulary.decode(packed) == [tokenizer.decode(w.ids, skip_special_tokens=False) for w in want]
    broken = [np.array(ids, "<u4").tobytes() for ids in ([100, 200, 50255, 198], [222], [246, 246])]
    assert vocabulary.decode(broken) == [tokenizer.decode(np.frombuffer(b, "<u4").tolist(), skip_special_tokens=False) for b in broken]


def test_small_memory_gives_the_same(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    with open(PATH, encoding="utf-8") as f:
        vocabulary = bpe.Vocabulary(f.read())
    rng = random.Random(1)
    for _ in range(20):
        texts = [" ".join(rng.choice(["the", "other", "wordy", f"x{rng.random()}"]) for _ in range(20)) for _ in range(4)]
        assert [np.frombuffer(p, "<u4").tolist() for p in vocabulary.encode(texts)] == [w.ids for w in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_frames_keep_other_columns_and_nulls(spark, tokenizer):
    rows = [(i, t, "ids", None) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string, lang string")
    got = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).withColumn("list", bpe.unpacked("ids"))
    assert got.columns == ["doc_id", "text", "lang", "ids", "decoded", "list"]
    for r in got.collect():
        assert r.list == tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    same = bpe.bpe_encode(df, PATH, decoded_col="decoded", drop_text=True)
    assert same.columns == ["doc_id", "lang", "ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.ids), r.decoded) for r in same.collect()) == sorted((r.doc_id, bytes(r.ids), r.decoded) for r in got.collect())
    assert bpe.bpe_encode(df.limit(0), PATH).count() == 0


def test_query_on_its_table(spark, sf_dir, tokenizer):
    from photonframe.llm.queries import QUERIES

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in QUERIES["op1_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
