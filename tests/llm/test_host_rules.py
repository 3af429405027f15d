import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from photonframe.llm import host_rules as hr

from .util import WORD

ODD = [None, "", "\n", "a", "a b c a b c", "x\nx\n\nx", "  pad\n  pad\npad", "# é*|", "é é é é é", "w " * 60, "a\n b\r\na\n b\r\n", "q" * 3000, "\n\na b c d"]


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force():
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab é\n #\t") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for at in range(0, len(texts), 37):
        part = texts[at : at + 37]
        got = hr.count_texts(pa.array(part, pa.string()))
        assert [tuple(int(got[c][i]) for c in hr.COUNTS) for i in range(len(part))] == [brute(t) for t in part]


def marked(symbols):
    """A hundred words with so many symbols."""
    return " ".join(f"word{i}" + ("#" if i < symbols else "") for i in range(100))


def test_hosts_change_verdicts(spark):
    """The same text stays on one host and goes on another; a clean one stays on both."""
    rows = [(i, marked(0), "good") for i in range(400)] + [(1000 + i, marked(60 if i < 300 else 0), "spam") for i in range(400)] + [(2000 + i, marked(60 if i < 40 else 0), "usual") for i in range(400)]
    rows += [(5000, marked(8), "good"), (5001, marked(8), "spam"), (5002, marked(15), "good"), (5003, marked(15), "spam"), (5004, marked(0), "spam"), (5005, marked(30), "good"), (5006, marked(0), None), (5007, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1)).withColumn("n_words", F.lit("x"))
    got = {r.doc_id: r for r in hr.quality_verdicts(df, host=F.col("source")).collect()}
    assert len(got) == len(rows)
    assert got[5000].host_verdict == "lenient" and got[5001].host_verdict == "strict"
    assert [got[i].kept for i in range(5000, 5008)] == [True, False, True, False, True, False, True, False]
    assert any(r.kept != (not r.base_failed) for r in got.values())
    assert all(r.kept for r in got.values() if not r.n_symbols and not r.base_failed)
    assert hr.quality_verdicts(df.limit(0), host=F.col("source")).count() == 0


def test_verdicts_by_plain_version(spark):
    """Moments, shrunk rates, factors and verdicts again, host by host."""
    rng = random.Random(9)
    rows = [(i, rng.choice([marked(0), marked(5), marked(12), marked(40), "short", "x " * 60, "tick tock\n" * 30, "a b " * 40 + "c"]) if rng.random() < {"p": 0.2, "q": 0.9}.get(h, 0.5) else marked(0), h) for i, h in enumerate(rng.choices(["p", "q", "r", None], k=500))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in hr.quality_verdicts(df, host=F.col("source")).collect()}
    x = {}
    for i, text, _ in rows:
        n, chars, symbols, lines, dup, repeats = brute(text)
        x[i] = {"base": n < 50 or 100 * repeats > 50 * n, "symbols": symbols / max(n, 1), "long_words": chars / max(n, 1), "short_words": n / max(chars, 1), "lines": dup / max(lines, 1)}
    limits = {"symbols": 0.1, "long_words": 20, "short_words": 0.55, "lines": 0.5}
    hosts = {h: [x[i] for i, _, g in rows if g == h] for h in ("p", "q", "r", None)}
    factor, inverse = {h: {} for h in hosts}, sum(1 / len(v) for v in hosts.values()) / 4
    for rule, limit in [*limits.items(), ("any", None)]:
        hit = (lambda d, rule=rule, limit=limit: d[rule] > limit) if limit else (lambda d: d["base"] or any(d[r] > m for r, m in limits.items()))
        rates = {h: sum(map(hit, v)) / len(v) for h, v in hosts.items()}
        m = sum(sum(map(hit, v)) for v in hosts.values()) / len(rows)
        mean = sum(rates.values()) / 4
        spread = max(sum((r - mean) ** 2 for r in rates.values()) / 3 - m * (1 - m) * inverse, 1e-9)
        s = max(2, min(1e6, m * (1 - m) / spread - 1))
        for h, v in hosts.items():
            p = (sum(map(hit, v)) + m * s) / (len(v) + s)
            factor[h][rule] = p if rule == "any" else (max(0.5, min(2, m / (1 - m) * (1 - p) / p)) if 0 < m < 1 else 1)
    for i, _, h in rows:
        assert abs(got[i].host_rate - factor[h]["any"]) < 1e-9
        gone = x[i]["base"] or factor[h]["any"] >= 0.95 or any(x[i][r] > m * round(factor[h][r], 6) for r, m in limits.items())
        assert got[i].kept == (not gone)
    assert len({round(f["symbols"], 3) for f in factor.values()}) > 1


def test_query_on_its_table(spark, sf_dir):
    from photonframe.llm.queries import QUERIES

    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in QUERIES["op8_host_rules"](spark, sf_dir).collect()}
    for d in docs:
        n, chars, symbols, _, lines, repeats = brute(d["text"])
        r = got[d["doc_id"]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert not (r.kept and r.base_failed)
