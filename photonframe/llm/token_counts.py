"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens. The distinct ones that a slice brings anew lie end to end in ragged numpy arrays (symbol, rank of the pair
that starts there, bytes covered), and in every round each sequence merges all places of its lowest-ranked pair at once, left to right;
a pre-token's count is the number of symbols that survive. A round's work is a few array operations over the sequences that still merge:
finished sequences and swallowed symbols are taken out as soon as they are a quarter of the arrays. Memory is about 30 bytes for each byte
of a slice's new pre-tokens, 13 of them kept through the rounds.

Counts are those of the tokenizers library for a byte-level BPE file, without added special tokens; an added token's string inside a text
counts as one. Null texts are empty and have no tokens. Repeated rows and ids are counted each; extra columns are ignored unless kept by
name, and kept columns of the names made here give way.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Vocabulary, pieces_pattern
from .shared import per_text

#: Pre-tokens whose counts a worker remembers between slices, and the length up to which it remembers one.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
NONE = np.int32(2**31 - 1)


class Counter:
    """Counts the tokens of texts under a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.bytes = np.array(vocabulary.byte_ids, np.int32)
        keys = np.array([x << 32 | y for x, y in vocabulary.by_rank], np.int64)
        merged = np.array([vocabulary.ranks[k][1] for k in keys.tolist()], np.int32)
        # A pair that is listed twice has its last rank, as in the vocabulary's own table.
        ranks = np.array([vocabulary.ranks[k][0] for k in keys.tolist()], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks, self.merged = keys[order], ranks[order], merged
        self.known: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.key_ranks[at], NONE)

    def sequences(self, pieces: list[bytes]) -> np.ndarray:
        """The number of tokens of each piece (none empty)."""
        lengths = np.array([len(p) for p in pieces], np.int64)
        left = lengths.copy()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        symbol, span, alive = self.bytes[data], np.ones(len(data), np.int32), np.ones(len(data), bool)
        rank = np.full(len(data), NONE, np.int32)
        ends = np.cumsum(lengths)
        if len(data):
            first = self.vocabulary.byte_ranks[data[:-1], data[1:]]
            rank[:-1] = np.where(first < 0, NONE, first)
            rank[ends - 1] = NONE
        own, starts, gone = np.arange(len(pieces)), ends - lengths, 0
        while len(own):
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == NONE
            sizes = np.diff(np.append(starts, len(rank)))
            if 4 * (gone + sizes[over].sum()) >= len(rank):
                # What is left of the sequences that still merge; each symbol counts as one place again.
                keep = np.repeat(~over, sizes) & alive
                symbol, rank = symbol[keep], rank[keep]
                span, alive = np.ones(len(rank), np.int32), np.ones(len(rank), bool)
                own, lowest = own[~over], lowest[~over]
                sizes = left[own]
                starts, gone = np.cumsum(sizes) - sizes, 0
                if not len(own):
                    break
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NONE))
            # Of places that overlap (a pair of equal symbols in a row), every second one from the left.
            following = hit + span[hit]
            count = np.arange(len(hit))
            begins = np.ones(len(hit), bool)
            begins[1:] = following[:-1] != hit[1:]
            run = np.maximum.accumulate(np.where(begins, count, 0))
            take = (count - run) % 2 == 0
            hit, other = hit[take], following[take]
            symbol[hit] = self.merged[rank[hit]]
            rank[other], alive[other] = NONE, False
            new = span[hit] + span[other]
            span[hit] = new
            last = hit + new - 1
            span[last] = new
            sequence = np.searchsorted(starts, hit, "right") - 1
            np.subtract.at(left, own[sequence], 1)
            gone += len(hit)
            # The pairs that start at a merged symbol and right before it.
            stop = np.append(starts[1:], len(rank))[sequence]
            rank[hit] = NONE
            inner = last + 1 < stop
            rank[hit[inner]] = self._rank(symbol[hit[inner]], symbol[last[inner] + 1])
            back = hit > starts[sequence]
            before = hit[back] - span[hit[back] - 1]
            rank[before] = self._rank(symbol[before], symbol[hit[back]])
        return left

    def count(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text."""
        find, vocabulary = pieces_pattern().findall, self.vocabulary
        rows: list[tuple[list[str], int]] = []
        for text in texts:
            if not text:
                rows.append(([], 0))
            elif vocabulary.split is None or not any(a in text for a in vocabulary.added):
                rows.append((find(text), 0))
            else:
                parts = vocabulary.split.split(text)
                rows.append(([p for part in parts if part not in vocabulary.added for p in find(part)], sum(part in vocabulary.added for part in parts)))
        every = set().union(*(pieces for pieces, _ in rows))
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        names = [p for p in every if p not in known]
        if names:
            known.update(zip(names, self.sequences([p.encode() for p in names]).tolist(), strict=True))
        out = [sum(map(known.__getitem__, pieces)) + added for pieces, added in rows]
        for p in names:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        return out


def token_counts(docs: DataFrame, path: str, keep: list[str], text_col: str = "text", limit: int = 512) -> DataFrame:
    """The columns `keep` with n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every text, under the tokenizer file
    at `path`, which the driver reads and ships."""
    with open(path, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def start() -> Callable[[list], list[pa.Array]]:
        counter = _counter(content.value)
        return lambda texts: [pa.array(counter.count(texts), pa.int64())]

    kept = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    sized = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, text_col])), F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long").alias("__bytes"))
    out = per_text(sized, [*kept, "__bytes"], text_col, "n_tokens long", start)
    return out.select(*(F.col(f"`{c}`") for c in kept), F.col("__bytes").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_counters: dict[str, Counter] = {}


def _counter(content: str) -> Counter:
    if content not in _counters:
        _counters.clear()
        _counters[content] = Counter(Vocabulary(content))
    return _counters[content]
