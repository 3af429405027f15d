"""Secret scans through a trigram index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: what must occur in any text that matches (Cox, 2012).
The index maps each trigram that some query uses to the documents whose lower-cased text holds it (postings); the postings of a clause
hold the documents with its rarest trigram only, as others cannot satisfy it. Each query's clauses intersect postings as bits of the trigrams
that a document brings. Documents that satisfy a query are candidates: their ids, counted and then broadcast (beyond `BROADCAST_ROWS` as
bits of their hashes, at most `FILTER_WORDS` words), meet the texts where these lie, and the rule's regular expression verifies them. Rules without a mandatory trigram scan every text.

Spans are in code points, end exclusive. Matches of a rule are leftmost and do not overlap; rules do not shadow one another.
Null and empty texts have no spans. Rows that repeat an id are scanned each (a candidate id is verified in all of its rows);
rows of null id are candidates of every kind without the index. Extra columns are ignored unless kept by name.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

Clause = frozenset[str]
Query = frozenset[Clause]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern (syntax common to Java and Python), the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base rules, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    # A greedy run that is too short holds no longer one, so the least lengths can stand in the patterns.
    Rule("access", r"AKIA[A-Z0-9]{16,}", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
)
#: Further kinds.
MORE = (
    Rule("private_key", r"-----BEGIN (RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY( BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    # From the slashes on, so that a run of letters is never tried from each of them.
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~%!*-]{3,}@"),
)
BROADCAST_ROWS = 500_000
#: Words of 64 bits that stand for any larger number of candidates (16 MB). Other ids with a candidate's bit are verified, too, and fail.
FILTER_WORDS = 1 << 20
#: Letters from common to rare; other characters count like the rare ones.
_COMMON = "etaoinsrhdlucmfywgpbvkxqjz"
#: Sets of exact strings and clauses stay below this many while a pattern is analysed; beyond, what is known is made weaker.
EXACT, CLAUSES = 32, 64


def _grams(text: str) -> Clause:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _reduced(clauses: set[Clause] | frozenset[Clause]) -> Query:
    """A disjunction without the clauses that others imply. The empty clause holds always."""
    least = frozenset(c for c in clauses if not any(o < c for o in clauses))
    return frozenset([frozenset()]) if frozenset() in least or len(least) > CLAUSES else least


def _and(a: Query, b: Query) -> Query:
    return _reduced({x | y for x, y in product(a, b)}) if len(a) * len(b) <= CLAUSES * CLAUSES else min(a, b, key=len)


ALWAYS: Query = frozenset([frozenset()])


class _Part:
    """What is known of a part of a pattern: all its strings if they are few (else None), a query, and its possible starts and ends."""

    def __init__(self, exact: frozenset[str] | None, query: Query = ALWAYS, heads: frozenset[str] = frozenset([""]), tails: frozenset[str] = frozenset([""])):
        self.exact, self.query, self.heads, self.tails = exact, query, heads, tails
        if exact is not None:
            self.query = _reduced({_grams(x) for x in exact}) if exact else frozenset()
            self.heads, self.tails = (frozenset(x[:2] for x in exact), frozenset(x[-2:] for x in exact))

    def weaker(self) -> _Part:
        return _Part(None, self.query, self.heads, self.tails)

    def then(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= EXACT:
            return _Part(frozenset(a + b for a, b in product(self.exact, other.exact)))
        seam = ALWAYS
        ends = self.exact if self.exact is not None else self.tails
        starts = other.exact if other.exact is not None else other.heads
        if len(ends) * len(starts) <= EXACT:
            seam = _reduced({_grams(a + b) for a, b in product(ends, starts)})
        heads = frozenset((a + b)[:2] for a, b in product(self.exact, other.heads)) if self.exact is not None else self.heads
        tails = frozenset((a + b)[-2:] for a, b in product(self.tails, other.exact)) if other.exact is not None else other.tails
        cut = lambda xs: xs if len(xs) <= EXACT else frozenset([""])
        return _Part(None, _and(_and(self.query, other.query), seam), cut(heads), cut(tails))

    def either(self, other: _Part) -> _Part:
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= EXACT:
            return _Part(self.exact | other.exact)
        cut = lambda xs: xs if len(xs) <= EXACT else frozenset([""])
        return _Part(None, _reduced(self.query | other.query), cut(self.heads | other.heads), cut(self.tails | other.tails))


EMPTY, ANY = _Part(frozenset([""])), _Part(None)


def _analyse(items) -> _Part:
    out = EMPTY
    for op, value in items:
        if op is sre.LITERAL:
            part = _Part(frozenset([chr(value).lower()]))
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in value:
                if kind is sre.LITERAL:
                    chars.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < EXACT:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            part = _Part(frozenset(chars)) if chars and len(chars) <= 8 else ANY
        elif op is sre.SUBPATTERN:
            part = _analyse(value[3])
        elif op is sre.BRANCH:
            part = _analyse(value[1][0])
            for branch in value[1][1:]:
                part = part.either(_analyse(branch))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inside = value
            one = _analyse(inside)
            if (low, high) == (0, 1):
                part = one.either(EMPTY)
            elif low == 0:
                part = ANY
            else:
                part = one
                for _ in range(min(low, 3) - 1):
                    part = part.then(one)
                part = part if low == high and low <= 3 else _Part(None, part.query, part.heads if part.exact is None else frozenset(x[:2] for x in part.exact), frozenset([""]))
        else:
            part = EMPTY if op is sre.AT else ANY
        out = out.then(part)
    return out


def trigram_query(pattern: str) -> Query:
    """A disjunction of sets of trigrams (lower case): every text that the pattern matches holds all of some set.
    {{}} says nothing: the rule has no mandatory trigram."""
    return _analyse(sre_parse.parse(pattern)).query


def rarest(clause: Clause) -> str:
    """The trigram of a clause whose letters are the least common."""
    return max(sorted(clause), key=lambda g: sum(_COMMON.find(c) if c in _COMMON else 1 if c == " " else len(_COMMON) for c in g))


def postings(docs: DataFrame, clauses: list[Clause], id_col: str, text_col: str) -> DataFrame:
    """The inverted index (trigram, id) over whole texts in lower case: trigrams of clauses, in documents with the clause's rarest one."""
    low = F.col("low")
    by_rarest: dict[str, set[str]] = {}
    for clause in clauses:
        by_rarest.setdefault(rarest(clause), set()).update(clause)
    held = [
        F.when(F.contains(low, F.lit(first)), F.array(F.lit(first), *(F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in sorted(rest - {first})))).otherwise(F.array().cast("array<string>"))
        for first, rest in sorted(by_rarest.items())
    ]
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("low"))
    return texts.select("id", F.explode(F.filter(F.concat(*held), lambda g: g.isNotNull())).alias("trigram"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(id, kinds) of the documents that satisfy some query: postings of each clause are intersected; kinds has the queries' numbers as bits."""
    bit = {g: i for i, g in enumerate(sorted({g for q in queries.values() for c in q for g in c}))}
    # Trigrams that a document brings, as bits in words of 60: aggregated with map-side combining, whatever the document's length.
    words = range(-(-len(bit) // 60))
    position = F.create_map(*(x for g, i in bit.items() for x in (F.lit(g), F.lit(i))))[F.col("trigram")]
    brought = index.withColumn("at", position).groupBy("id").agg(
        *(F.bit_or(F.when((F.col("at") / 60).cast("int") == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(60)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words)
    )

    def holds(query: Query) -> Column:
        out = F.lit(False)
        for clause in query:
            both = F.lit(True)
            for w in words:
                mask = sum(1 << (bit[g] - 60 * w) for g in clause if bit[g] // 60 == w)
                if mask:
                    both &= F.col(f"w{w}").bitwiseAND(F.lit(mask)) == F.lit(mask)
            out |= both
        return out

    kinds = F.lit(0).cast("long")
    for n, query in queries.items():
        kinds = kinds.bitwiseOR(F.when(holds(query), F.lit(1 << n).cast("long")).otherwise(F.lit(0).cast("long")))
    return brought.select("id", kinds.alias("kinds")).filter("kinds <> 0")


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, ord, kind, end>> of a rule's matches in `text`: pieces between matches give the positions."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(whole, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.transform(whole, F.length), lambda gap, n: F.struct(gap.alias("gap"), n.alias("n")))
    steps = F.zip_with(steps, lengths, lambda s, g: F.struct(s["gap"].alias("gap"), s["n"].alias("n"), g.alias("g")))
    kind = "array<struct<start:long,ord:int,kind:string,end:long,good:boolean>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + s["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (begin + s["n"]).alias("end"), (s["g"] >= rule.least).alias("good"))
        return F.struct((begin + s["n"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    spans = F.aggregate(steps, start, step, lambda state: state["out"])
    return F.filter(spans, lambda s: s["good"])


def _word(name: str) -> Column:
    """The word of the filter that holds an id's bit."""
    return F.pmod(F.xxhash64(name), F.lit(FILTER_WORDS))


def _bit(name: str) -> Column:
    """An id's bit in its word, from another hash."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.hash(name), F.lit(64)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., spans) of every row; spans: array<struct<start, ord, kind, end, good>> by start, then the rules' order."""
    if len(rules) > 60:
        raise ValueError("at most 60 rules a scan")
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q != ALWAYS}
    extra = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), *extra, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if indexed:
        index = postings(rows, sorted({c for q in indexed.values() for c in q}, key=sorted), "id", "text")
        found = saved(candidates(index, indexed), "candidates").withColumnRenamed("id", "cid")
        every = F.lit((1 << len(rules)) - 1).cast("long")
        if found.count() <= BROADCAST_ROWS:
            rows = rows.join(F.broadcast(found), F.expr("id = cid"), "left").drop("cid")
        else:
            bits = found.groupBy(_word("cid").alias("word")).agg(F.bit_or(_bit("cid")).alias("bits"))
            rows = rows.join(F.broadcast(bits), _word("id") == F.col("word"), "left").drop("word")
            rows = rows.withColumn("kinds", F.when(F.col("bits").bitwiseAND(_bit("id")) != 0, every)).drop("bits")
        rows = rows.withColumn("kinds", F.when(F.col("id").isNull(), every).otherwise(F.coalesce("kinds", F.lit(0).cast("long"))))
    none = F.array().cast("array<struct<start:long,ord:int,kind:string,end:long,good:boolean>>")
    parts = []
    for order, rule in enumerate(rules):
        text = F.col("text")
        wanted = text.rlike(rule.pattern)
        if order in indexed:
            wanted = (F.col("kinds").bitwiseAND(F.lit(1 << order)) != 0) & wanted
        parts.append(F.when(wanted, rule_spans(text, rule, order)).otherwise(none))
    spans = F.array_sort(F.concat(*parts))
    return rows.select(F.col("id").alias(id_col), *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), spans.alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """`text` with every stretch that spans cover replaced by `mark`."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        cut = F.substring(text, (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], cut, F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)
