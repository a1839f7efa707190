"""The thin queries over the operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.llm import (
    bpe,
    decontamination,
    divergence,
    licenses,
    lm_scoring,
    mixing,
    near_dedup,
    prefix_trie,
    quality_model,
    quality_rules,
    substring_dedup,
    token_files,
    toxicity,
)
from landshift.llm.common import read, scratch, trained_on


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.line_cleaning(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_failed", "lost_share")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is all documents labelled good, but for the held-out ones; the background is all documents."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return lm_scoring.score(docs, labels.where((F.col("quality") == 1) & trained_on(F.col("doc_id"))))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.round_trip(read(spark, sf_dir, "documents"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"), size=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~trained_on(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85).drop("text_hash")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents")).drop("blocks")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_files.write(read(spark, sf_dir, "documents"), path)
    found = token_files.read_documents(spark, path).select("part", "chunk", "offset", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    starts = token_files.chunk_starts(spark, path)
    return found.join(starts, ["part", "chunk"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_lm_scoring, op4_bpe, op5_substring_dedup, op6_quality_classifier, op7_toxicity, op8_near_dedup, op9_license_scans, op10_token_files, op11_source_mixing, op12_prefix_trie, op13_divergence)
}
