"""From raw documents to token digests: five stages of the corpus operators, in order.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; all but the last
return the columns of ``documents``, others that docs may have too. Null, empty and very long texts, rows without doc_id, repeated rows and tables without
rows are cases that each stage names. Between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clausewright.llm import byte_bpe, decontamination, language_id, near_copies, suffix_dedup
from clausewright.llm._shared import materialise


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an identifiable language go: null, empty and letterless texts, and predictions below language_id.LEAST_SCORE.

    Equal texts and repeated rows share their fate, with doc_id or without; where nothing has a language to learn from, all texts with a letter stay.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest doc_id; repeated rows of it stay repeated.

    Sets of five-word shingles at an exact Jaccard similarity of 0.8 or more link texts; a text of fewer than five words is one shingle. Null, empty and
    word-less texts are one class. Rows that share a doc_id but not the text are different documents. Rows without doc_id go where a document
    with one stands for them; of those that only copy each other, one stays.
    """
    return near_copies.keep_representatives(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated byte strings leave the texts; a character that loses a byte goes too, and so do texts that lose everything.

    Of equal passages the one in the smallest doc_id stays. Null and empty texts, and repeated rows, lose nothing to themselves; a null doc_id is the largest.
    """
    return suffix_dedup.remove_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none, and repeated rows share their fate."""
    return decontamination.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of what is left: doc_id, n_tokens, ids_sha256, decoded_sha256, one row for each row; a null text is empty."""
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return byte_bpe.encode(docs, bpe, digests=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode_and_decode),
]

#: No SQL for a trained classifier and a tokenizer; tests/llm compares each operator with brute force and the stages with rows derived by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
