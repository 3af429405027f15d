import hashlib
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from photonframe.llm import secret_scan as ss

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def all_spans(text):
    out = base_spans(text)
    for order, rule in enumerate(ss.BASE + ss.MORE):
        if not rule.base:
            out += [(m.start(), order, rule.kind, m.end()) for m in re.finditer(rule.pattern, text or "")]
    return sorted(out)


ODD = [
    None, "", " ", "password", "token=abc", "TOKEN = 'abcdef'", "é🙂 secret: abcdef123 🙂 token=zzzzzz", "secret=token:abcdefgh", "apikey=\"a.b/c+d=\"", "API_KEY:xxxxxx,api__key=yyyyyy",
    "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 13, "xAKIA" + "9" * 30 + "x", "0" * 23, "f" * 24, "g" + "a1" * 40 + "g", "passwd=" + "a" * 30, "token=" * 50 + "abcdef",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890", "AIza" + "x" * 35, "sk_live_" + "a" * 16, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + "." + "c" * 9, "https://user:pass1@host",
    "Key apiKey=abcdef", "word " * 30000 + "token=abcdef " + "a" * 24,
]


def test_trigram_queries():
    assert ss.trigram_query(r"[0-9a-f]{24,}") == ss.ALWAYS
    assert ss.trigram_query("abcd") == {frozenset({"abc", "bcd"})}
    assert ss.trigram_query("ab(c|d)e?f") == {frozenset({"abc", "bcf"}), frozenset({"abc", "bce", "cef"}), frozenset({"abd", "bdf"}), frozenset({"abd", "bde", "def"})}
    assert ss.trigram_query("abc.*xyz") == {frozenset({"abc", "xyz"})}
    assert ss.trigram_query("(abc)*d") == ss.ALWAYS and ss.trigram_query("abc|.") == ss.ALWAYS
    assert frozenset({"tok", "oke", "ken"}) in ss.trigram_query(ss.BASE[0].pattern)
    assert ss.trigram_query(ss.BASE[1].pattern) == {frozenset({"aki", "kia"})}


def test_queries_hold_for_every_match():
    """A text that matches holds all trigrams of some clause."""
    samples = ["Password: abcdef", "passwd=abcdef", "SECRET=abcdef", "Token:'abcdef", "apikey=abcdef", "API_KEY=abcdef", *ODD[10:]]
    for rule in ss.BASE + ss.MORE:
        query = ss.trigram_query(rule.pattern)
        for t in samples:
            if t and (m := re.search(rule.pattern, t)):
                assert any(all(g in m[0].lower() for g in clause) for clause in query), rule.kind


def test_spans_against_brute_force(spark):
    rng = random.Random(6)
    bits = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", "'", '"', "abcdef", "xy", "é", "🙂", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "\n", "://", "a:bcd@"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    rows = [(i, t, "k", 1) for i, t in enumerate(texts)] + [(None, "token=abcdef", "k", 1), (None, "none", "k", 1), (6, texts[6], "k", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kinds string, id int").repartition(3)
    got = ss.scan(df, keep=("text", "kinds")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s.start, s.ord, s.kind, s.end) for s in r.spans] == all_spans(r.text)
    assert ss.scan(df.limit(0)).count() == 0


def test_candidates_are_those_that_hold_a_clause(spark):
    """The intersected postings against the queries on the texts themselves."""
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["pass", "word", "password", "tok", "token", "api", "_key", "AKIA", "://", "ghp_", "xoxb-", "rest"]) for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rules = [r for r in ss.BASE + ss.MORE if ss.trigram_query(r.pattern) != ss.ALWAYS]
    queries = {n: ss.trigram_query(r.pattern) for n, r in enumerate(rules)}
    df = spark.createDataFrame([(i, t.lower()) for i, t in enumerate(texts)], "id long, text string")
    clauses = [c for q in queries.values() for c in q]
    got = {r.id: r.kinds for r in ss.candidates(ss.postings(df, clauses, "id", "text"), queries).collect()}
    for i, t in enumerate(texts):
        assert got.get(i, 0) == sum(1 << n for n, q in queries.items() if any(all(g in t.lower() for g in c) for c in q))
    assert all(ss.rarest(c) in c for c in clauses)


def test_candidates_as_bits_give_the_same_and_no_text_is_shuffled(spark, monkeypatch):
    """Few words of bits as well, in which ids without a secret share a candidate's bit."""
    rows = [(i % 7 if i % 5 else None, f"n {i} token=abcdef{i}" if i % 3 else "none") for i in range(60)] + [(i, "none") for i in range(100, 1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(map(str, ss.scan(df).collect()))
    monkeypatch.setattr(ss, "BROADCAST_ROWS", 0)
    for words in (ss.FILTER_WORDS, 2):
        monkeypatch.setattr(ss, "FILTER_WORDS", words)
        out = ss.scan(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(str, out.collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_redaction_and_plan(spark):
    df = spark.createDataFrame([(1, "é token=abcdef, AKIA" + "A" * 16 + " end"), (2, "nothing"), (3, None)], "doc_id long, text string")
    out = ss.scan(df, keep=("text",)).withColumn("text", ss.redacted(F.col("text"), F.col("spans")))
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["é [SECRET], [SECRET] end", "nothing", None]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    got = QUERIES["op5_secret_scan"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    text = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    for r in got:
        base = base_spans(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest()
        assert r.spans == text(all_spans(docs[r.doc_id]))
