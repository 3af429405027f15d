"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols by a lexicon: insults and threats, targets, negations and words of reported speech; commas are symbols, too. Transducers
rewrite the symbols of a clause: insults and threats after a negation, or after a word of reported speech, up to the next comma (but for an
insult that no more than its target precedes: "you idiot"), insults near a target before them, and threats that a target and a modal verb
announce. They are composed into one machine. A second
one, composed likewise, runs over the reversed clause: reported speech named behind it, and targets behind the word. What comes out are kinds
of matched clauses. A document's score is a logistic function of how many clauses of each kind it has (n clauses weigh n / (n + 1) of the
most, so no count is cut off) and of how dense clauses with a doubtful word are in it, with weights fitted on labelled texts around a
prior that stands for the grammar. Weights are bounded so that the grammar holds whatever the labels: a target never makes an insult or a
threat less toxic, a threat at someone counts at least as an insult, and negated or reported words weigh little.

The insult lexicon is learned from labelled texts. Beginnings of several words of toxic texts come first, although clean texts hold such words
at times: these are doubtful words, a kind of their own. Then words and word beginnings are chosen greedily by how many texts not yet explained
they occur in, so that words which merely accompany insults are not taken. Training uses about `sample` labelled texts, by hash
of the id, and words and beginnings that occur in enough of its toxic texts (`least`, and one in a thousand), so what the driver sees is bounded
by the sample; scoring covers every whole text.

Null and empty texts have no clause and get the score of the intercept. A text with contradicting labels counts as toxic; null labels are not
learned from. Repeated rows are scored each. Extra columns are ignored unless kept by name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import per_text
from .textscan import chunks

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;|\n…]+")
#: A word, or a comma.
TOKEN = re.compile(r"[^\W\d_]+|,")
#: Fixed lists of common words.
INSULTS = "idiot moron stupid scum trash loser clown worthless pathetic disgusting"
#: Stems of threats with their endings (a dash stands for none).
THREATS = {
    "kill hurt murder destroy": "- s ed ing", "strangl": "e es ed ing", "töt": "e en et est ete eten", "umbring": "e en t st", "vernicht": "e en et est ete eten", "mat": "ar o as a an aré ará aremos é ó",
    "destru": "ir iré irá yo yes ye", "golpe": "ar o as a an aré ará", "tu": "er erai era ons ez", "frapp": "er e es erai era ons ez", "détrui": "re s t rai ra sons",
}
THREAT_FORMS = frozenset(stem + ("" if e == "-" else e) for stems, ends in THREATS.items() for stem in stems.split() for e in ends.split())
TARGETS = "you your yours yourself u he him she her they them people du dich dir dein ihr euch sie tú te tu usted ustedes vous toi votre ils"
NEGATIONS = "no not never cannot isn aren wasn don doesn didn won wouldn without nobody nicht kein keine niemals nunca jamás sin pas jamais sans"
MODALS = "will ll shall should must gonna going deserve deserves werde wirst wird werden sollte sollst musst voy vas va vamos debes deberías vais allons devrais dois"
REPORTS = "said says told called wrote quoted claimed according sagte sagt schrieb nannte dijo dice escribió llamó dit écrit appelé selon"
#: Prefix lengths that the lexicon may use.
LENGTHS = (3, 4, 5, 6, 7, 8)
#: Kinds of matched clauses, with the prior weight of one, and the bounds of the weight. Insults count every attack, that is, targeted insults and
#: aimed threats, too, and those for someone count again: so the weights of these are what a target adds.
KINDS = {"insult": 6.0, "targeted": 2.0, "negated": 0.5, "reported": 0.5, "threat": 0.5, "aimed": 1.0, "doubtful": 1.0}
BOUNDS = {"insult": (0.0, math.inf), "targeted": (0.0, math.inf), "negated": (0.0, 1.0), "reported": (0.0, 1.0), "threat": (0.0, 2.0), "aimed": (0.0, math.inf), "doubtful": (0.0, math.inf)}
#: Prior weight of the share of doubtful clauses.
SHARE = 4.0


@dataclass
class Transducer:
    """A deterministic letter transducer: arcs[state][symbol] = (next state, output). Missing symbols pass and keep the state."""

    arcs: dict[int, dict[str, tuple[int, str]]]
    start: int = 0

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs[state].get(symbol, (state, symbol))

    def run(self, symbols: str) -> str:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return "".join(out)


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that applies `second` to what `first` puts out."""
    number = {(first.start, second.start): 0}
    arcs: dict[int, dict[str, tuple[int, str]]] = {}
    todo = [(first.start, second.start)]
    while todo:
        pair = todo.pop()
        row = arcs.setdefault(number[pair], {})
        for s in alphabet:
            a, middle = first.step(pair[0], s)
            b, out = second.step(pair[1], middle)
            if (a, b) not in number:
                number[a, b] = len(number)
                todo.append((a, b))
            row[s] = (number[a, b], out)
    return Transducer(arcs)


#: Input symbols: I insult, W doubtful word, T threat, G target, N negation, R reported speech, M modal verb, o any other word, c a comma.
INPUT = "IWTGNRMoc"
#: Symbols that transducers put out besides.
MADE = "nrKJ"


def _fading(mark: str, scope: int, changes: dict[str, str]) -> Transducer:
    """For `scope` words after a `mark`, the symbols `changes` are rewritten."""
    arcs: dict[int, dict[str, tuple[int, str]]] = {0: {mark: (scope, mark)}}
    for k in range(1, scope + 1):
        arcs[k] = {s: (k - 1, changes.get(s, s)) for s in INPUT + MADE}
        arcs[k][mark] = (scope, changes.get(mark, mark))
    return Transducer(arcs)


def _until_comma(mark: str, changes: dict[str, str], but: str = "") -> Transducer:
    """From a `mark` to the next comma the symbols `changes` are rewritten, save those of `but` that stand right behind a target."""
    arcs: dict[int, dict[str, tuple[int, str]]] = {0: {mark: (1, mark)}}
    arcs[1] = {s: (1, changes.get(s, s)) for s in INPUT + MADE} | {"c": (0, "c"), "G": (2, "G")}
    arcs[2] = arcs[1] | {s: (1, s) for s in but}
    return Transducer(arcs)


def _announced() -> Transducer:
    """A target and a modal verb within three words, in either order, and within four more a threat: the threat is aimed."""
    every = INPUT + MADE
    arcs = {0: {"G": (3, "G"), "M": (10, "M")}}
    arcs |= {k: {s: (k - 1, s) for s in every} | {"G": (3, "G"), "M": (7, "M")} for k in (1, 2, 3)}
    arcs |= {k: {s: (k - 1 if k > 4 else 0, s) for s in every} | {"G": (3, "G"), "T": (0, "K")} for k in (4, 5, 6, 7)}
    arcs |= {k: {s: (k - 1 if k > 8 else 0, s) for s in every} | {"G": (7, "G"), "M": (10, "M")} for k in (8, 9, 10)}
    return Transducer(arcs)


def _composed(parts: list[Transducer]) -> Transducer:
    out = parts[0]
    for part in parts[1:]:
        out = compose(out, part, INPUT + MADE)
    return out


def forward_parts() -> list[Transducer]:
    """Negation, reported speech, then threats and insults behind their target."""
    return [_until_comma("N", {"I": "n", "T": "o", "W": "o"}, "I"), _until_comma("R", {"I": "r", "T": "o", "W": "o"}), _announced(), _fading("G", 5, {"I": "J"})]


def backward_parts() -> list[Transducer]:
    """Over the reversed clause: reported speech that is named behind what was said, and targets behind the word."""
    return [_fading("R", 8, {"I": "r", "J": "r", "T": "o", "K": "o", "W": "o"}), _fading("G", 3, {"T": "K"}), _fading("G", 3, {"I": "J"})]


class Grammar:
    """The two composed machines."""

    def __init__(self) -> None:
        self.forward, self.backward = _composed(forward_parts()), _composed(backward_parts())

    def run(self, symbols: str) -> str:
        return self.backward.run(self.forward.run(symbols)[::-1])[::-1]


#: The kind that an output symbol counts for.
OUTPUT = {"I": "insult", "J": "targeted", "n": "negated", "r": "reported", "T": "threat", "K": "aimed", "W": "doubtful"}


@dataclass
class Model:
    """Lexicon, weights and machine."""

    words: set[str]
    prefixes: dict[int, set[str]]
    doubtful_prefixes: dict[int, set[str]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [-3.0, *KINDS.values(), SHARE])

    def __post_init__(self):
        self.machine = Grammar()
        self.begins = {k: self.prefixes.get(k, set()) | self.doubtful_prefixes.get(k, set()) for k in LENGTHS if k in self.prefixes or k in self.doubtful_prefixes}
        self.fixed = {w: s for s, ws in (("M", MODALS), ("R", REPORTS), ("N", NEGATIONS), ("G", TARGETS)) for w in ws.split()} | dict.fromkeys(THREAT_FORMS, "T") | {",": "c"}
        self.fixed |= dict.fromkeys(self.words, "I")
        self.sought = self.words | THREAT_FORMS

    def symbol(self, word: str) -> str:
        if word in self.fixed:
            return self.fixed[word]
        if any(word[:k] in p for k, p in self.prefixes.items()):
            return "I"
        return "W" if any(word[:k] in p for k, p in self.doubtful_prefixes.items()) else "o"

    def counts(self, text: str | None) -> list[int]:
        """Clauses of each kind, and words."""
        out = Counter()
        total = 0
        if text:
            low = text.lower()
            words = set(WORD.findall(low))
            if not words.isdisjoint(self.sought) or any(not p.isdisjoint({w[:k] for w in words}) for k, p in self.begins.items()):
                known = {w: self.symbol(w) for w in words} | {",": "c"}
                for clause in CLAUSE.split(low):
                    symbols = "".join([known[w] for w in TOKEN.findall(clause)])
                    total += len(symbols) - symbols.count("c")
                    if "I" in symbols or "W" in symbols or "T" in symbols:
                        out.update({OUTPUT[o] for o in self.machine.run(symbols) if o in OUTPUT})
        return [*(out[k] for k in KINDS), total]

    def score(self, counts: list[int]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], evidence(counts)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def evidence(counts: list[int]) -> list[float]:
    """What `counts` weigh: n / (n + 1) for n clauses of a kind, and the share of doubtful ones, a clause being taken as eight words (two more
    guard short texts), as tables and shouting have no clauses of their own. Attacks on someone count as insults, and once more as targeted."""
    *kinds, total = counts
    of = dict(zip(KINDS, kinds, strict=True))
    at_someone = of["targeted"] + of["aimed"]
    of |= {"insult": of["insult"] + at_someone, "targeted": at_someone}
    return [*(n / (n + 1) for n in of.values()), of["doubtful"] / (total / 8 + 2)]


def _features(text: str | None) -> set[str]:
    """Distinct words w, their beginnings b*, and beginnings b** of several words."""
    words = set(WORD.findall(text.lower())) if text else set()
    begins = Counter(w[:k] + "*" for w in words for k in LENGTHS if len(w) >= k)
    return words | begins.keys() | {f + "*" for f, n in begins.items() if n > 1}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each label that hold each feature, summed over a slice."""
    for batch in batches:
        for part in chunks(batch, "text"):
            toxic, other = Counter(), Counter()
            for label, text in zip(part.column(part.schema.get_field_index("toxic")).to_pylist(), part.column(part.schema.get_field_index("text")).to_pylist(), strict=True):
                (toxic if label else other).update(_features(text))
            keys = list(toxic.keys() | other.keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([other[k] for k in keys], pa.int64())], ["feature", "pos", "neg"])


def choose(held: list[set[str]], negatives: dict[str, int], open_: list[bool], least: int, cost: float) -> list[str]:
    """Features that explain the toxic texts `held` that are open, greedily: most new texts first, each clean text with the feature
    counting against it `cost` times; ties to longer features, then by name. What they explain is no longer open."""
    out: list[str] = []
    gain: Counter[str] = Counter()
    holders: dict[str, list[int]] = {}
    for i, h in enumerate(held):
        if open_[i]:
            gain.update(h)
            for f in h:
                holders.setdefault(f, []).append(i)
    allowed = {f for f in gain if gain[f] >= least}
    while allowed:
        best = min(allowed, key=lambda f: (negatives.get(f, 0) * cost - gain[f], -len(f.rstrip("*")), f))
        if gain[best] < least or gain[best] <= cost * negatives.get(best, 0):
            break
        out.append(best)
        for i in holders[best]:
            if open_[i]:
                open_[i] = False
                gain.subtract(held[i])
        allowed = {f for f in allowed if f != best and gain[f] >= least}
    return out


def _split(picked: list[str]) -> tuple[set[str], dict[int, set[str]]]:
    begins = {k: {f[:-1] for f in picked if f.endswith("*") and len(f) == k + 1} for k in LENGTHS}
    return {f for f in picked if not f.endswith("*")}, {k: p for k, p in begins.items() if p}


def _held(known: Broadcast):
    """The features of each text that are in `known`, as their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                held = [[number[f] for f in _features(t) if f in number] for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("h")), pa.array(held, pa.list_(pa.int32()))], ["h", "held"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 3) -> Model:
    """A model from about `sample` labelled texts of docs (doc_id, text) and labels (doc_id, toxic)."""
    context = docs.sparkSession.sparkContext
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # A threshold on the hash takes the sample without ordering the labels.
    share = min(1.0, sample / max(1, marked.count()))
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(marked), "doc_id").filter("text is not null")
    # Equal texts teach once, so that copies do not weigh.
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.max_by("text", "doc_id").alias("text"), F.max("toxic").alias("toxic")).persist()
    try:
        seen = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        n_toxic, n_other = seen.get(1, 0), seen.get(0, 0)
        counts = texts.mapInArrow(_count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        least = max(least, n_toxic // 1000)
        several = F.col("feature").endswith("**")
        fair = (F.col("pos") >= least) & (F.col("neg") <= 0.004 * n_other) & (F.col("pos") > F.when(several, 2).otherwise(5) * F.col("neg"))
        # A feature that stays is in one of a thousand toxic texts of the sample at least: at most a thousand times what one text has.
        rows = counts.filter(fair).collect()
        names = sorted(r.feature for r in rows)
        negatives = {r.feature: r.neg for r in rows}
        known = context.broadcast({f: i for i, f in enumerate(names)})
        found = texts.filter("toxic = 1").select("h", "text").mapInArrow(_held(known), "h long, held array<int>").collect()
        held = [{names[i] for i in r.held} for r in sorted(found, key=lambda r: r.h)]
        open_ = [True] * len(held)
        enough = max(least, n_toxic // 500)
        single = {f for f in negatives if not f.endswith("**")}
        often = {r.feature for r in rows if r.pos >= max(5, n_toxic // 100)} & single
        doubtful = _split([f[:-1] for f in choose([h - single for h in held], negatives, open_, max(least, n_toxic // 150), 1)])[1]
        picked = choose([h & single for h in held], negatives, open_, enough, 5)
        # Words of many toxic texts need not bring many new ones.
        open_ = [not any(f in h for f in picked) for h in held]
        begun = {k: tuple(p) for k, p in doubtful.items()}
        plain = {f for f in often if not any(f[:k].rstrip("*") in p for k, p in begun.items())}
        words, prefixes = _split(picked + choose([h & plain for h in held], negatives, open_, 1, 5))
        model = Model(words | set(INSULTS.split()), prefixes, doubtful)
        shipped = context.broadcast(model)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = Counter((int(y), *shipped.value.counts(t)) for y, t in zip(batch["toxic"].to_pylist(), batch["text"].to_pylist(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in got], pa.list_(pa.int64())), pa.array(list(got.values()), pa.int64())], ["key", "n"])

        grouped = texts.mapInArrow(summed, "key array<long>, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    finally:
        texts.unpersist()
    model.weights = fit([(r.key[0], evidence(r.key[1:]), r.n) for r in sorted(grouped, key=lambda r: r.key)], model.weights)
    return model


def fit(rows: list[tuple[int, list[float], int]], prior: list[float], strength: float = 0.1) -> list[float]:
    """Logistic weights by Newton steps around `prior`, each weight within its bounds: one that a step would take beyond stays there
    while its slope points outwards."""
    if not rows:
        return prior
    x = np.array([[1.0, *c] for _, c, _ in rows])
    y, n = np.array([r[0] for r in rows], float), np.array([r[2] for r in rows], float)
    limits = [(-math.inf, math.inf), *BOUNDS.values(), (0.0, math.inf)]
    low, high = (np.array(side) for side in zip(*limits))
    mean, w = np.array(prior), np.array(prior)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (y - p)) - strength * (w - mean)
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        free = ~(((w <= low) & (grad < 0)) | ((w >= high) & (grad > 0)))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hess[np.ix_(free, free)], grad[free])
        after = np.clip(w + np.clip(step, -2, 2), low, high)
        done = np.abs(after - w).max() < 1e-9
        w = after
        if done:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with score, predicted and clauses (matched clauses) of every row; kept columns of those names give way."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        own = shipped.value

        def apply(texts: list[str | None]) -> list[pa.Array]:
            counts = [own.counts(t) for t in texts]
            scores = [own.score(c) for c in counts]
            return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([sum(c[:-1]) for c in counts], pa.int64())]

        return apply

    return per_text(docs, keep, text_col, "score double, predicted int, clauses long", start)
