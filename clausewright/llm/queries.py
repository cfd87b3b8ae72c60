"""The operators' queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import byte_bpe, decontamination, knn_quality, language_id, licences, masked_lm, personal_data, prefix_trie, quality_rules, resampling, simhash, suffix_dedup, warc
from clausewright.llm._shared import materialise, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, target = shared_path(spark, "warc"), shared_path(spark, "warc-members")
    warc.write_archives(table(spark, sf_dir, "pages"), source)
    stored, _ = warc.normalise(spark, source, target)
    return warc.read_records(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, model)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("licences", ",").alias("licences"), "n_matches", "n_sentences", F.array_join("unmatched", ",").alias("unmatched"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.encode(table(spark, sf_dir, "documents"), bpe, digests=True)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op9_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return masked_lm.score(docs, masked_lm.train(docs))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return knn_quality.score(docs, knn_quality.train(docs, table(spark, sf_dir, "labels")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.summary(personal_data.find_spans(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = materialise(prefix_trie.sequences(table(spark, sf_dir, "conversations")), "turns")
    return prefix_trie.prefix_trie(prefix_trie.borrow_beginnings(own))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_warc, op2_quality_rules, op3_simhash, op4_licences, op5_byte_bpe, op6_suffix_dedup, op7_decontamination, op8_language_id, op9_masked_lm, op10_knn_quality, op11_importance_resampling, op12_personal_data, op13_prefix_trie)
    return {f.__name__: f for f in made}
