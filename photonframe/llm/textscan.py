"""Vectorised word scanning over Arrow string buffers (numpy only).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All functions take whole texts;
long ones are hashed window by window, so memory follows the window and not the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WINDOW = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_COEF = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U64(2) + U64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_pow: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        m = max(n, _WINDOW + 4096)
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _pow[name] = np.cumprod(steps, dtype=np.uint64)
    return _pow["p"], _pow["i"]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    _, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the n + 1 word offsets of the rows."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = solid[edge]
    last[edge - 1] = solid[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; with `fold`, A-Z count as a-z."""
    out, table, at = np.empty(len(starts), np.uint64), _FOLD if fold else _BYTE, 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _WINDOW, side="right")))
        part = table[data[base : ends[to - 1]]]
        power, inverse = _powers(len(part))
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * power[: len(part)], out=total[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * _COEF[15])
        at = to
    return out


def grams(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and the offsets of the rows; a row of 1 to n-1 words gives one window, the whole."""
    count = np.diff(offsets)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    if out_offsets[-1] == 0:
        return np.zeros(0, np.uint64), out_offsets
    begin = np.arange(out_offsets[-1]) + np.repeat(offsets[:-1] - out_offsets[:-1], made)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    total = np.zeros(len(begin), np.uint64)
    short = np.repeat(np.where(count < n, count, n), made)
    for k in range(n):
        total += np.where(short > k, padded[begin + k], U64(0)) * _COEF[k]
    return mix(total + short.astype(np.uint64) * _COEF[14]), out_offsets
