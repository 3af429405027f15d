"""Byte-level BPE encoding and decoding with a pair occurrence index.

Texts are cut into pieces. The distinct pieces that a batch brings anew are laid end to end, and every adjacent pair that has
a rank is mapped to the list of its positions. Active ranks are applied in ascending order: all positions of a pair are
merged at once, left to right, and the pairs that this makes are added to their lists (positions whose pair has gone are
skipped when their list's turn comes). Pieces never meet, so memory follows the distinct pieces of one slice of a batch.

The tokenizer file is read by the driver from a path that is a parameter and shipped to the executors (its size is that of
the vocabulary). Null texts count as empty and give no ids. An added token's string in a text becomes that token.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import chunks

#: Distinct pieces whose ids a worker remembers between slices.
REMEMBERED = 250_000


@cache
def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(test) -> str:
    out, first = [], None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and test(c):
            first = c if first is None else first
        elif first is not None:
            out.append(f"\\U{first:08x}" + (f"-\\U{c - 1:08x}" if c - 1 > first else ""))
            first = None
    return "".join(out)


@cache
def pieces_pattern() -> re.Pattern:
    """The byte-level pre-tokenizer: contractions, letters, numbers, other marks, white space."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter, number = _ranges(lambda c: kinds[c] == "L"), _ranges(lambda c: kinds[c] == "N")
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    # Letters and numbers come first, as most pieces are such; no contraction starts like one.
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Vocabulary:
    """Ranks, bytes and added tokens of a byte-level BPE tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only byte-level BPE files without a normalizer or an added prefix space are supported")
        if any(a[k] for a in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that strip or ask for whole words are not supported")
        chars, vocab = byte_chars(), model["vocab"]
        self.byte_ids = [0] * 256
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        self.ranks: dict[int, tuple[int, int]] = {}
        self.by_rank: list[tuple[int, int]] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[a], vocab[b]
            self.by_rank.append((x, y))
            self.ranks[x << 32 | y] = (rank, vocab[a + b])
        self.token_bytes = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for text, i in self.added.items():
            self.token_bytes[i] = text.encode()
        self.decoding = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.split = re.compile("(" + "|".join(re.escape(a) for a in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.byte_table = np.array(self.byte_ids)
        self.byte_ranks = np.full((256, 256), -1, np.int32)
        index = {i: b for b, i in enumerate(self.byte_ids)}
        for rank, (x, y) in enumerate(self.by_rank):
            if x in index and y in index:
                self.byte_ranks[index[x], index[y]] = rank
        self.known: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in self.added.values()}
        self.older: dict[str | int, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece (none empty), by the pair occurrence index over all of them."""
        starts = np.cumsum([0, *map(len, pieces)])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ranked = np.full(len(data), -1, np.int32)
        ranked[:-1] = self.byte_ranks[data[:-1], data[1:]]
        ranked[starts[1:] - 1] = -1
        links = np.arange(1, len(data) + 1)
        links[starts[1:] - 1] = -1
        following = links.tolist()
        links = np.arange(-1, len(data) - 1)
        links[starts[:-1]] = -1
        previous = links.tolist()
        ids = self.byte_table[data].tolist()
        at = np.flatnonzero(ranked >= 0)
        at = at[np.argsort(ranked[at], kind="stable")]
        found_ranks, first = np.unique(ranked[at], return_index=True)
        positions = {r: part.tolist() for r, part in zip(found_ranks.tolist(), np.split(at, first[1:]), strict=True)} if len(at) else {}
        ranks, get = self.ranks, self.ranks.get
        active = list(positions)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            left, right = self.by_rank[rank]
            merged = ranks[left << 32 | right][1]
            found = positions.pop(rank)
            if len(found) > 1:
                found.sort()
            for i in found:
                if ids[i] != left or (j := following[i]) < 0 or ids[j] != right:
                    continue
                ids[i], ids[j] = merged, -1
                k = following[i] = following[j]
                if k >= 0:
                    previous[k] = i
                    if hit := get(merged << 32 | ids[k]):
                        if hit[0] not in positions:
                            positions[hit[0]] = []
                            heapq.heappush(active, hit[0])
                        positions[hit[0]].append(i)
                if (h := previous[i]) >= 0 and (hit := get(ids[h] << 32 | merged)):
                    if hit[0] not in positions:
                        positions[hit[0]] = []
                        heapq.heappush(active, hit[0])
                    positions[hit[0]].append(h)
        flat = np.array(ids, np.int64)
        keep = flat >= 0
        packed = flat[keep].astype("<u4").tobytes()
        ends = (np.concatenate(([0], np.cumsum(keep)))[starts] * 4).tolist()
        return [packed[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        find, known = pieces_pattern().findall, self.known
        rows: list[list[str | int]] = []
        for text in texts:
            if not text:
                rows.append([])
            elif self.split is None or not any(a in text for a in self.added):
                rows.append(find(text))
            else:
                row: list[str | int] = []
                for part in self.split.split(text):
                    row += [self.added[part]] if part in self.added else find(part)
                rows.append(row)
        every = set().union(*rows)
        fresh = every.difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            self.older, self.known = known, {i: known[i] for i in self.added.values()}
            known = self.known
            fresh = every.difference(known)
        older = self.older
        known.update((p, older[p]) for p in fresh if p in older)
        names = [p for p in fresh if p not in known]
        if names:
            known.update(zip(names, self.merge([p.encode() for p in names]), strict=True))
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def decode(self, packed: list[bytes | None]) -> list[str]:
        """Text of packed ids; bytes that are not UTF-8 become U+FFFD. An id outside the vocabulary gives nothing."""
        table, out = self.decoding, []
        for row in packed:
            ids = np.frombuffer(row or b"", "<u4")
            out.append(b"".join(map(table.__getitem__, (ids[ids < len(table)] if len(ids) and ids.max() >= len(table) else ids).tolist())).decode("utf-8", "replace"))
        return out


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    if content not in _loaded:
        _loaded.clear()
        _loaded[content] = Vocabulary(content)
    return _loaded[content]


def _shipped(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, drop_text: bool = False) -> DataFrame:
    """`docs` with `ids_col`, the ids packed as little-endian unsigned 32-bit integers (see `unpacked`), and with `decoded_col`
    their decoding in the same pass; without the text if `drop_text`."""
    content = _shipped(docs, path)
    kept = [c for c in docs.columns if c not in (ids_col, decoded_col)]
    out = [c for c in kept if not (drop_text and c == text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            for part in chunks(batch, text_col, 1 << 20):
                ids = vocabulary.encode(part.column(part.schema.get_field_index(text_col)).to_pylist())
                made = {ids_col: pa.array(ids, pa.binary())}
                if decoded_col:
                    made[decoded_col] = pa.array(vocabulary.decode(ids), pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in out), *made.values()], [*out, *made])

    base = docs.select(*(F.col(f"`{c}`") for c in kept))
    given = base.select(*(F.col(f"`{c}`") for c in out), F.lit(b"").alias(ids_col), *([F.lit("").alias(decoded_col)] if decoded_col else []))
    return base.mapInArrow(run, given.schema)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """`df` with `text_col`, the text of the packed ids, special tokens included."""
    content = _shipped(df, path)
    kept = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = vocabulary.decode(part.column(part.schema.get_field_index(ids_col)).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], [*kept, text_col])

    base = df.select(*(F.col(f"`{c}`") for c in kept))
    return base.mapInArrow(run, base.withColumn(text_col, F.lit("")).schema)


def unpacked(ids: str):
    """Packed ids as array<bigint>, for use in a select."""
    hexed = f"hex({ids})"
    byte = lambda k: f"conv(substr({hexed}, i * 8 + {2 * k + 1}, 2), 16, 10) * {256**k}"
    return F.expr(f"transform(filter(sequence(0, cast(length({ids}) / 4 as int)), i -> i < length({ids}) / 4), i -> cast({' + '.join(map(byte, range(4)))} as bigint))")
