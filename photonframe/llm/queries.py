"""The registered opN queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_repair, histogram_shards, host_rules, html_main, lang_id, merkle, ngram_join, nn_descent, oracles, secret_scan, source_mix, token_counts, toxicity
from .shared import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and their decoding, as digests."""
    coded = bpe.bpe_encode(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER, decoded_col="decoded", drop_text=True)
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of documents that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held_out = lang_id.crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs, labels.filter(~held_out))
    return toxicity.score(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return source_mix.mix(documents(spark, sf_dir, "doc_id", "text", "source")).drop("members")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of 4-word shingle sets at Jaccard similarity 0.85."""
    return ngram_join.ngram_classes(documents(spark, sf_dir, "doc_id", "text"), 4, (85, 100))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and spans of the base kinds, and all spans."""
    out = secret_scan.scan(documents(spark, sf_dir, "doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secret_scan.BASE]))
    return out.select(
        "doc_id",
        *(of(r.kind) for r in secret_scan.BASE),
        F.sha2(secret_scan.joined(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("spans")).alias("spans"),
    )


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    graph = nn_descent.build(vectors)
    return nn_descent.search(graph, vectors.filter("vec_id % 100 = 0"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by compression, learned from the documents that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = lang_id.crc_mod("doc_id", 4) == 2
    learned = lang_id.train(docs.filter(~held_out))
    out = lang_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), learned, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document; its source is the host."""
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    out = host_rules.quality_verdicts(docs, host=F.col("source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_verdict", "kept")


def op9_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    out = histogram_shards.histogram_shards(documents(spark, sf_dir, "doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_main.main_texts(pages, ["page_id", "url"])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: its faults and its cheapest repair."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return conversation_repair.repaired(conversation_repair.damaged(rows))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(documents(spark, sf_dir, "doc_id", "text"), TOKENIZER, ["doc_id"])


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a proof gives for a tampered one."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.document_leaf(F.col("n_chars") + 1))
    out = merkle.manifest(docs, "doc_id", "lang", merkle.document_leaf(F.col("n_chars")), {"tampered": tampered})
    root = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_source_mix": op3_source_mix,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_secret_scan": op5_secret_scan,
    "op6_nn_descent": op6_nn_descent,
    "op7_language_id": op7_language_id,
    "op8_host_rules": op8_host_rules,
    "op9_histogram_shards": op9_histogram_shards,
    "op10_html_main_text": op10_html_main_text,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_token_counts": op12_token_counts,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Learned, hashed and searched results have no SQL; tests hold those queries against plain versions.
ORACLES: dict[str, str] = {
    "op4_ngram_jaccard_join": oracles.ngram_components(4, 85, 100),
    "op5_secret_scan": oracles.secret_spans(),
    "op8_host_rules": oracles.host_verdicts(),
    "op11_conversation_repair": oracles.repaired_conversations(),
    "op13_merkle_manifest": oracles.merkle_manifest(),
}
