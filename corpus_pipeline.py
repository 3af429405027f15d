"""The corpus pipeline: toxic documents go, one of each group of near duplicates stays, secrets are masked, sources are mixed to
target weights, and what is left is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. Empty tables pass through; null texts count as empty but stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonframe.llm import bpe, ngram_join, secret_scan, source_mix, toxicity
from photonframe.llm.queries import TOKENIZER
from photonframe.llm.shared import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that toxicity scoring does not reject; learned from all labels of the documents."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs, model, list(COLUMNS)).filter("predicted = 0").select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, Jaccard similarity 0.8): that of the smallest id.
    Documents without words are in no group. Rows of one id with different texts are documents of their own; of equal rows one stays."""
    return ngram_join.one_of_each(docs.select(*COLUMNS), 5, (80, 100))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by a mark; n_chars follows."""
    found = secret_scan.scan(docs, keep=("text", "lang", "source", "n_chars"))
    text = secret_scan.redacted(F.col("text"), F.col("spans"))
    n_chars = F.when(F.size("spans") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return found.select("doc_id", F.when(F.col("text").isNull(), F.col("text")).otherwise(text).alias("text"), "lang", "source", n_chars.alias("n_chars")).select(*COLUMNS)


def sources_mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix to target weights takes them: not at all, once or twice. Documents without words stay once."""
    return source_mix.repeated(docs.select(*COLUMNS)).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the packed ids of every row."""
    out = bpe.bpe_encode(docs.select("doc_id", "text", "source"), TOKENIZER)
    return out.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("ngram_jaccard_join", near_duplicates_out),
    ("secret_scan", secrets_masked),
    ("source_mix", sources_mixed),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learning and hashing in the stages have no SQL; tests/llm hold each stage against a plain version.
ORACLE_SQL: str | None = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
