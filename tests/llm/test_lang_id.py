import random
import zlib

import pyarrow.parquet as pq

from photonframe.llm import lang_id

SYLLABLES = {"aa": ["the", "ing", "er", "th", "on"], "bb": ["ung", "sch", "ein", "keit", "zu"], "cc": ["eau", "qué", "ment", "ou", "ès"]}


def made(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_learns_and_handles_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, made(rng, lang, rng.randint(5, 60)), lang, "x") for i, lang in enumerate(list(SYLLABLES) * 40)]
    rows += [(500, None, "aa", None), (501, "", "bb", None), (502, "123 ½²Ⅷ !!", None, None), (None, "thering", "aa", None), (503, made(rng, "bb", 9000).upper(), None, None), (503, made(rng, "bb", 9000).upper(), None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    learned = lang_id.train(df.filter("doc_id < 60"))
    assert set(learned) == set(SYLLABLES)
    got = lang_id.predict(df.select("doc_id", "lang", "text"), learned, ["doc_id", "lang"]).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (500, 501, 502, 503)] == ["und", "und", "und", "bb"]
    held = [r for r in got if r.doc_id and 60 <= r.doc_id < 500]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    nothing = lang_id.train(df.limit(0))
    assert nothing == {} and {r.lang_pred for r in lang_id.predict(df.select("doc_id", "text"), nothing, ["doc_id"]).collect()} == {"und"}


def test_plain_version_and_margins(spark):
    """Sizes of whole texts, one compressor a language, and rejection of narrow margins."""
    import zstandard

    rng = random.Random(6)
    rows = [(i, made(rng, lang, n), lang) for i, (lang, n) in enumerate((lang, n) for lang in SYLLABLES for n in (1, 2, 5, 30, 300, 5000))]
    rows += [(90, "the ung eau", None), (91, "zzz", None), (92, rows[3][1] + " " + rows[9][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = lang_id.train(df)
    got = {r.doc_id: r for r in lang_id.predict(df, learned, ["doc_id"], margin=0.05).collect()}
    for i, text, _ in rows:
        data = f" {' '.join(lang_id.WORDS.findall(text.lower()))} ".encode()
        sizes = {}
        for lang, content in learned.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=held, compression_params=lang_id.settings()).compress(data))
        order = sorted(sizes.values())
        assert sizes[got[i].lang_pred] <= 1.02 * order[0] + 2
    assert got[91].rejected and not got[4].rejected and got[92].score < got[4].score


def test_dictionaries_do_not_depend_on_ids_copies_or_order(spark):
    rng = random.Random(7)
    texts = [(made(rng, lang, rng.randint(5, 40)), lang) for lang in SYLLABLES for _ in range(30)]
    first = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string")
    rng.shuffle(texts)
    copies = [(None, t, lang) for t, lang in texts for _ in range(3)] + [(7, "both of them", "aa"), (7, "both of them", "bb")]
    again = spark.createDataFrame(copies, "doc_id long, text string, lang string")
    a, b = lang_id.train(first), lang_id.train(again)
    assert a == {k: b[k] for k in a} and not any(b"both of them" in v for v in b.values())
    long_only = spark.createDataFrame([(made(rng, "aa", 9000), "aa")] * 2 + [("und so", "bb")], "text string, lang string")
    got = lang_id.train(long_only, size=200)
    assert len(got["aa"]) > 9000 and got["bb"] == b" und so "


def test_kept_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "x", 2.0, "the ing")], "`a.b` long, lang_pred string, score double, text string")
    got = lang_id.predict(df, {"aa": b" the ing er "}, ["a.b", "lang_pred", "score"])
    assert got.columns == ["a.b", "lang_pred", "score", "rejected"] and got.collect()[0][:2] == (1, "aa")


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    lang = {d["doc_id"]: d["lang"] for d in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    got = QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(lang) and len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
