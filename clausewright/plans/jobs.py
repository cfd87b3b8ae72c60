"""Whole jobs: building an index, answering a batch of questions, flat vector indexes and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import hooks
from clausewright.operators import flat, intents as I, outline, retrieve as R, stats
from clausewright.sources import tables


def build_index(docs: DataFrame, generate: hooks.Generate, path: str, version: str = "1.0", regenerate: bool = False, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks with intent ids, intents), written under ``path`` step by step; steps whose output exists are not run again."""
    spark = docs.sparkSession
    tables.write_chunks(outline.generate_chunks(docs), path, version, regenerate=regenerate)
    chunks = tables.read_chunks(spark, path)
    tables.write_intents(I.generate_intents(chunks, generate, tasks=tasks), path, version, regenerate)
    intents = tables.read_intents(spark, path)
    tables.write_chunks_with_intents(I.attach_intent_ids(chunks, intents), path, regenerate)
    return spark.read.parquet(f"{path}/chunks_with_intents"), intents


def intent_vectors(intents: DataFrame, encode: hooks.Encode) -> DataFrame:
    """Intents with the text that is indexed and its vector. Write it before searching it more than once."""
    text = I.intent_corpus_text(*map(F.col, ("user_query", "excerpt", "conditions", "category")))
    return intents.withColumn("text", text).withColumn("embedding", hooks.encoder(encode)(F.col("text")))


def answer_batch(
    questions: DataFrame, intents: DataFrame, chunks: DataFrame, encode: hooks.Encode, generate: hooks.Generate,
    score: hooks.ScorePairs | None = None, model: str = "", k_intents: int | None = 5, k_clauses: int | None = 3, tasks: int | None = None,
) -> DataFrame:
    """One row per question: query_id, query, answer, model, usage, sources, top_intents, error. A failed call keeps its row."""
    queries = R.prepare_queries(questions, encode, k_intents, k_clauses)
    found, clauses = R.retrieve(queries, intents, chunks, encode=None if score else encode, score=score)
    prompts = R.answer_prompts(queries, R.build_context(clauses, "answer"))
    replies = hooks.generate_replies(prompts, generate, attempts=1, tasks=tasks)
    rows = replies.join(R.extract_sources(clauses), "query_id", "left").join(R.top_intents(found), "query_id", "left")
    failed = F.concat(F.lit("抱歉，生成答案時發生錯誤: "), F.col("error"))
    return rows.select("query_id", "query", F.coalesce("content", failed).alias("answer"), F.lit(model).alias("model"), "usage", "sources", "top_intents", "error")


def index_stats(chunks: DataFrame, intents: DataFrame) -> dict[str, DataFrame]:
    return {
        "outline": stats.outline_counts(chunks),
        "query_types": stats.share_counts(intents, "query_type", "其他"),
        "categories": stats.share_counts(intents, "category", "未分類", top=10),
        "tags": stats.label_counts(intents, "semantic_tags", top=15),
        "average": stats.avg_intents_per_clause(chunks, intents),
        "quality": stats.quality_summary(intents),
    }


def build_flat_index(docs: DataFrame, encode: hooks.Encode, base: str, version: str, notes: str, date: str, model: str, regenerate: bool = False) -> DataFrame:
    """Flat chunks with vectors under ``base``/``version``; returns the manifest. ``vec_id`` orders nothing, it only names a row."""
    chunks = flat.flat_chunks(docs, version)
    vectors = chunks.withColumn("embedding", hooks.encoder(encode)(F.col("text"))).withColumn("vec_id", F.monotonically_increasing_id())
    return tables.write_versioned(vectors, base, version, notes, date, model, regenerate)


def read_flat_index(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{version}/chunks")
