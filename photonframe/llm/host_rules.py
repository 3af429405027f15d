"""Quality rules pooled by host.

Every text is counted once (words, symbols, repeated lines, words inside repeated 3-word windows). Failures of every rule are summed by
host, and each host's rate of each rule is shrunk towards that of all hosts by the rule's own empirical beta prior (fitted by moments).
The verdicts are joined back to the documents.

A text that breaks a base rule goes. The limit of a soft rule moves with the host: it is divided by the ratio of the host's shrunk odds of
breaking the rule to the prior's, at most by `reach` and at least by 1 / `reach`. Where hosts do not differ, the prior is narrow and
every limit is the rule's own; a host that breaks a rule oftener than others is held to less, one that rarely does may exceed it. On a host whose shrunk
rate of texts that break any rule is at least `banned`, every text goes. A text without a mark of any rule stays on any other host.

Null texts have no words and so fail. Rows of null host are one host. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved
from .textscan import SPACE, U64, buffers, chunks, grams, mix, word_hashes, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Hosts up to which verdicts are broadcast; beyond, they are joined by shuffling.
BROADCAST_ROWS = 200_000
#: The rules by name: base ones drop a text by themselves.
BASE = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
}
#: Soft rules: what is measured, and its limit.
SOFT = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 0.1),
    "long_words": ("word_chars / greatest(n_words, 1)", 20.0),
    "short_words": ("n_words / greatest(word_chars, 1)", 0.55),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", 0.5),
}


def _per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def count_texts(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts of every text, over all its bytes."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    starts, ends, at = words(data, offsets)
    n_words = np.diff(at)
    hashes = word_hashes(data, starts, ends, False)
    row_of = lambda positions: np.searchsorted(offsets, positions, side="right") - 1
    solid = (data & 0xC0) != 0x80
    chars = _per_row(row_of(np.flatnonzero(solid & ~SPACE[data])), n)
    symbols = _per_row(row_of(np.flatnonzero(SYMBOL[data])), n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate((offsets[:-1], breaks + 1)))
    line_starts = line_starts[line_starts < len(data)]
    line_rows = row_of(line_starts)
    line_ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], offsets[line_rows + 1])
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_rows = line_starts[full], line_ends[full], line_rows[full]
    salted = mix(word_hashes(data, line_starts, line_ends, False) ^ mix(line_rows.astype(np.uint64)))
    _, first = np.unique(salted, return_index=True)
    n_lines = _per_row(line_rows, n)
    dup_lines = n_lines - _per_row(line_rows[first], n)

    windows, window_at = grams(hashes, at, 3)
    made = np.diff(window_at)
    window_rows = np.repeat(np.arange(n), made)
    salted = mix(windows ^ mix(window_rows.astype(np.uint64) + U64(1 << 40)))
    _, inverse, counts = np.unique(salted, return_inverse=True, return_counts=True)
    hit = (counts[inverse] > 1) if len(windows) else np.zeros(0, bool)
    begin = (np.arange(len(windows)) + np.repeat(at[:-1] - window_at[:-1], made))[hit]
    covered = np.zeros(len(starts) + 3, bool)
    for k in range(3):
        covered[begin + k] = True
    repeats = _per_row(np.repeat(np.arange(n), n_words)[covered[: len(starts)]], n)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_lines": n_lines, "n_dup_lines": dup_lines, "n_repeat_words": repeats}


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """(id_col, host, the counts) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                column = lambda c, part=part: part.column(part.schema.get_field_index(c))
                counts = count_texts(column("text"))
                yield pa.RecordBatch.from_arrays([column("id"), column("host"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["id", "host", *COUNTS])

    base = docs.select(F.col(id_col).alias("id"), (F.lit(None) if host is None else host).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, host string, {', '.join(f'{c} long' for c in COUNTS)}").withColumnRenamed("id", id_col)


def _broken() -> dict[str, Column]:
    """Whether a text breaks each rule at its own limit."""
    return {r: F.expr(e) for r, e in BASE.items()} | {r: F.expr(e) > limit for r, (e, limit) in SOFT.items()}


def _shrunk(bad: str, mean: str, strength: str) -> Column:
    return (F.col(bad) + F.col(mean) * F.col(strength)) / (F.col("host_docs") + F.col(strength))


def host_verdicts(counts: DataFrame, reach: float = 2.0, banned: float = 0.95) -> DataFrame:
    """(host, host_docs, host_rate, f_<soft rule>..., host_verdict): the shrunk rate of texts that break a rule, the factor of each
    soft limit, and banned, strict, lenient or keep."""
    broken = _broken()
    rules = [*SOFT, "any"]
    hit = broken | {"any": reduce(or_, broken.values())}
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"), *(F.sum(hit[r].cast("long")).alias(f"k_{r}") for r in rules))
    moments = [F.avg(1 / F.col("host_docs")).alias("i")]
    for r in rules:
        moments += [(F.sum(f"k_{r}") / F.sum("host_docs")).alias(f"m_{r}"), F.coalesce(F.var_samp(F.col(f"k_{r}") / F.col("host_docs")), F.lit(0.0)).alias(f"v_{r}")]
    prior = hosts.agg(*moments)
    # Variance between hosts without that of sampling; the beta prior that fits it weighs as `s` documents.
    for r in rules:
        within = F.col(f"m_{r}") * (1 - F.col(f"m_{r}"))
        spread = F.greatest(F.col(f"v_{r}") - within * F.col("i"), F.lit(1e-9))
        prior = prior.withColumn(f"s_{r}", F.greatest(F.lit(2.0), F.least(F.lit(1e6), within / spread - 1)))
    out = hosts.crossJoin(F.broadcast(prior))
    for r in SOFT:
        m, p = F.col(f"m_{r}"), _shrunk(f"k_{r}", f"m_{r}", f"s_{r}")
        ratio = F.when((m > 0) & (m < 1), m / (1 - m) * (1 - p) / p).otherwise(1.0)
        out = out.withColumn(f"f_{r}", F.round(F.greatest(F.lit(1 / reach), F.least(F.lit(reach), ratio)), 6))
    factors = [F.col(f"f_{r}") for r in SOFT]
    out = out.withColumn("host_rate", _shrunk("k_any", "m_any", "s_any"))
    verdict = F.when(F.col("host_rate") >= banned, "banned").when(F.least(*factors) < 0.8, "strict").when(F.greatest(*factors) > 1.25, "lenient").otherwise("keep")
    return out.select("host", "host_docs", "host_rate", *factors, verdict.alias("host_verdict"))


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, reach: float = 2.0, banned: float = 0.95) -> DataFrame:
    """(id_col, counts, base_failed, soft_failed, host_rate, host_verdict, kept) of every row."""
    counts = saved(text_counts(docs, id_col, text_col, host), "counts")
    verdicts = saved(host_verdicts(counts, reach, banned), "hosts")
    if verdicts.count() <= BROADCAST_ROWS:
        verdicts = F.broadcast(verdicts)
    out = counts.alias("d").join(verdicts.alias("h"), F.expr("d.host <=> h.host"), "left").drop("host")
    out = out.withColumn("base_failed", reduce(or_, (F.expr(e) for e in BASE.values())))
    out = out.withColumn("soft_failed", reduce(or_, (F.expr(e) > limit * F.col(f"f_{r}") for r, (e, limit) in SOFT.items())))
    return out.drop(*(f"f_{r}" for r in SOFT)).withColumn("kept", F.expr("not (base_failed or soft_failed or host_verdict = 'banned')"))
