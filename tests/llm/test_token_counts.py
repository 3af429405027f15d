import random
import time

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from photonframe.llm import bpe
from photonframe.llm import token_counts as tc

from .test_bpe import ODD, PATH


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture()
def counter():
    with open(PATH, encoding="utf-8") as f:
        return tc.Counter(bpe.Vocabulary(f.read()))


def want(tokenizer, texts):
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_same_counts_as_the_library(tokenizer, counter, monkeypatch):
    rng = random.Random(11)
    alphabet = "abc ABC\n\t '.,123éßñ漢🙂  stre"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    texts += ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 3000))) for _ in range(40)]
    texts += [c * n for c in ("a", "ab", "=", "\n", "é", "<|endoftext|>") for n in (1, 2, 3, 7, 64, 513)]
    assert counter.count(texts) == want(tokenizer, texts)
    assert counter.count(texts[::-1]) == want(tokenizer, texts[::-1])
    monkeypatch.setattr(tc, "REMEMBERED", 20)
    for at in range(0, len(texts), 50):
        assert counter.count(texts[at : at + 50]) == want(tokenizer, texts[at : at + 50])


def test_one_very_long_piece(tokenizer, counter):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    began = time.time()
    assert counter.count([text, "x" * 300_000]) == want(tokenizer, [text, "x" * 300_000])
    assert time.time() - began < 60


def test_frames(spark, tokenizer):
    rows = [(i % 7 if i else None, t, 5, "l") for i, t in enumerate(ODD * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, lang string")
    got = tc.token_counts(df, PATH, ["doc_id", "lang", "n_tokens"], limit=20)
    assert got.columns == ["doc_id", "lang", "n_bytes", "n_tokens", "over_limit"]
    counts = want(tokenizer, [r[1] for r in rows])
    expected = sorted((str(r[0]), "l", len((r[1] or "").encode()), n, n > 20) for r, n in zip(rows, counts))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == expected
    assert tc.token_counts(df.limit(0), PATH, ["doc_id"]).count() == 0
    assert set(tc.token_counts(df, PATH, ["text"]).columns) == {"text", "n_bytes", "n_tokens", "over_limit"}


def test_query_on_its_table(spark, sf_dir, tokenizer):
    from photonframe.llm.queries import QUERIES

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    counts = want(tokenizer, [d["text"] for d in docs])
    got = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, n in zip(docs, counts, strict=True):
        r = got[d["doc_id"]]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((d["text"] or "").encode()), n, n > 512)
    assert public_tokenizers.path("byte_bpe_50k.json") == PATH
