"""Language identification by compression.

For each language a zstandard raw-content dictionary is laid out from whole labelled texts. A whole text is encoded with every
dictionary, by one search for all lengths, and the smallest result names the language; a narrow margin rejects.

Texts are compared as their words (letters only, in lower case, single spaces), so that layout, digits and shouting do not count. The dictionaries
take each distinct text once, and none that occurs under two languages: copies do not weigh. Which texts a dictionary holds is decided by
their hash, those of up to `short` bytes first, so reruns agree whatever the ids: as many as fit into `size` bytes. The size is bounded by
`total` bytes over all languages. The sample is bounded: about `per_lang` texts of a language are looked at.

Texts without a letter, and null texts, are `und`. Ties go to the language with most labelled texts, then by name. Rows of null
language or text are not learned from; ids play no part. Repeated rows are predicted each. Extra columns are ignored unless kept by
name; kept columns of the names made here give way.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import per_text

WORDS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
_UNIT = 1 << 30


def plain(text: str | None) -> str:
    """The words of a text in lower case."""
    return " ".join(WORDS.findall(text.lower())) if text else ""


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = 300, size: int = 32 << 10, short: int = 512, total: int = 64 << 20) -> dict[str, bytes]:
    """A dictionary for each language, from about `per_lang` texts of each; languages with most labelled texts first."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    sized = rows.select("lang", "h", F.octet_length("text").alias("bytes"))
    texts = sized.groupBy("h").agg(F.min("lang").alias("lang"), F.max("lang").alias("other"), F.min("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    texts = texts.withColumn("own", F.expr("lang = other")).withColumn("long", F.col("bytes") > short)
    langs = texts.groupBy("lang").agg(
        F.sum("rows").alias("rows"), F.count(F.when(F.expr("own and not long"), 1)).alias("n_short"), F.count(F.when(F.expr("own and long"), 1)).alias("n_long"), F.min(F.when(F.col("own"), F.col("bytes"))).alias("least")
    )
    common = langs.orderBy(F.desc("rows"), "lang").collect()
    if not common:
        return {}
    # A threshold on the hash of distinct texts takes the sample, so that no task ranks a language.
    size = min(size, total // len(common))
    parts = [(c.lang, min(1.0, per_lang / max(1, c.n_short)), min(1.0, max(0, per_lang - c.n_short) / max(1, c.n_long)), c.least) for c in common]
    place = F.pmod(F.xxhash64(F.lit(1), F.col("h")), F.lit(_UNIT)) / _UNIT
    looked = texts.filter("own").join(F.broadcast(labelled.sparkSession.createDataFrame(parts, "lang string, p_short double, p_long double, least int")), "lang")
    looked = looked.filter((place < F.when(F.col("long"), F.col("p_long")).otherwise(F.col("p_short"))) | (F.col("bytes") == F.col("least")))
    looked = looked.withColumn("place", place).select("lang", "h", "bytes", "long", "place").collect()
    chosen: dict[int, str] = {}
    for lang in (c.lang for c in common):
        used = 0
        mine = sorted((r for r in looked if r.lang == lang), key=lambda r: (r.long, r.place, r.h))
        fit = [r for r in mine if r.bytes <= size] or sorted(mine, key=lambda r: (r.bytes, r.h))[:1]
        for r in fit:
            if used == 0 or used + r.bytes <= size:
                chosen[r.h] = lang
                used += r.bytes
    picked = labelled.sparkSession.createDataFrame(list(chosen.items()), "h long, of string") if chosen else None
    found = rows.join(F.broadcast(picked), "h").groupBy("of", "h").agg(F.min("text").alias("text")).collect() if chosen else []
    held = {c.lang: sorted((r.h, plain(r.text)) for r in found if r.of == c.lang) for c in common}
    return {lang: (" " + " ".join(t for _, t in mine) + " ").encode() for lang, mine in held.items()}


def settings() -> zstandard.ZstdCompressionParameters:
    """One search for texts of all lengths: about level 12, in tables that fit a core's cache; matches from five bytes on."""
    return zstandard.ZstdCompressionParameters(
        window_log=19, chain_log=15, hash_log=15, search_log=4, min_match=5, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )


class Coder:
    """Compressors with one dictionary each."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            loaded = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            loaded.precompute_compress(compression_params=settings())
            self.compressors.append(zstandard.ZstdCompressor(dict_data=loaded, compression_params=settings()))

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin (the share of the second-best size that the best saves)."""
        words = plain(text)
        # Words may also be made of superscripts and the like, which are no letters.
        if not words or not self.langs or not any(map(str.isalpha, words)):
            return UNKNOWN, 0.0, 0.0
        data = f" {words} ".encode()
        sizes = [len(c.compress(data)) for c in self.compressors]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        whole = sum(2.0 ** (min(0, sizes[best] - s) / max(1.0, (words.count(" ") + 1) / 4)) for s in sizes)
        return self.langs[best], 1.0 / whole, (second - sizes[best]) / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text_col: str = "text", margin: float = 0.01) -> DataFrame:
    """The columns `keep` with lang_pred, score and rejected (the margin is below `margin`) of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def start():
        coder = Coder(shipped.value)

        def apply(texts: list[str | None]) -> list[pa.Array]:
            got = [coder.predict(t) for t in texts]
            return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] < margin for g in got], pa.bool_())]

        return apply

    return per_text(docs, keep, text_col, "lang_pred string, score double, rejected boolean", start)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo `divisor`; null counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor
