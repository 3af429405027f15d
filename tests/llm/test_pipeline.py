"""Each stage against a plain version over whole tables, and the stages together."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

from .test_secret_scan import all_spans
from .util import WORD, components, shingles


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """The rows that each stage returns, and those that it is given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = []
    for name, stage in cp.STAGES:
        got = cp.saved(stage(spark, docs, sf_dir), name)
        out.append((docs.collect(), got.collect()))
        docs = got
    return out


def test_columns(spark, sf_dir, kept):
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    for _, rows in kept[:-1]:
        assert rows and list(rows[0].asDict()) == columns


def test_toxic_documents_go(spark, sf_dir, kept):
    given, got = kept[0]
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = {r.doc_id for r in got}
    clean = [d.doc_id for d in given if toxic.get(d.doc_id) == 0]
    bad = [d.doc_id for d in given if toxic.get(d.doc_id) == 1]
    assert sum(i in ids for i in clean) >= 0.99 * len(clean) and sum(i in ids for i in bad) <= 0.4 * len(bad)
    assert set(got) <= set(given)


def test_one_of_each_group_stays(kept):
    given, got = kept[1]
    sets = {d.doc_id: shingles(d.text, 5) for d in given}
    of = components(sorted(sets), sets, 80, 100)
    assert {r.doc_id for r in got} == {i for i in sets if of[i] == i} and len(got) == len({r.doc_id for r in got})


def test_secrets_are_masked(kept):
    given, got = kept[2]
    after = {r.doc_id: r for r in got}
    assert len(got) == len(given)
    for d in given:
        want, at = [], 0
        for start, _, _, end in all_spans(d.text):
            if start >= at:
                want += [d.text[at:start], "[SECRET]"]
            at = max(at, end)
        want = "".join(want) + d.text[at:]
        assert after[d.doc_id].text == want and after[d.doc_id].n_chars == (len(want) if want != d.text else d.n_chars)


def test_mix_repeats_rows(spark, kept):
    given, got = kept[3]
    taken = {r.doc_id: r for r in cp.source_mix.mix(spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    seen = Counter(r.doc_id for r in got)
    for d in given:
        n = len(WORD.findall(d.text))
        assert seen[d.doc_id] == (1 if n == 0 else taken[d.doc_id].taken // n)


def test_encoding(kept):
    given, got = kept[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {d.doc_id: d.text for d in given}
    assert len(got) == len(given)
    for r in got:
        ids = tokenizer.encode(text[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)


def test_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c d e f", "en", "s", 11), (3, "a b c d e f", "en", "s", 11), (4, "A b c d e f", None, None, 11), (None, "z token=abcdef", "en", "t", 5), (None, None, None, "t", None)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in cp.STAGES:
            table = cp.saved(stage(spark, table, sf_dir), name)
        got = table.collect()
        assert not got or {r.doc_id for r in got} <= {None, 1, 2, 3} and sum(r.doc_id == 3 for r in got) <= 2


def test_run(spark, sf_dir, kept):
    assert sorted(map(tuple, cp.run(spark, sf_dir).collect())) == sorted(map(tuple, kept[4][1]))
