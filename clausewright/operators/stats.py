"""Statistics of outlines, intents and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outline_counts(chunks: DataFrame) -> DataFrame:
    """n_clauses, n_items and n_subitems of all documents."""
    items = F.col("clause.items")
    subs = F.aggregate(items, F.lit(0), lambda n, i: n + F.size(i["sub_items"]))
    return chunks.agg(
        F.count("*").alias("n_clauses"), F.coalesce(F.sum(F.size(items)), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.sum(subs), F.lit(0)).cast("long").alias("n_subitems")
    )


def share_counts(rows: DataFrame, column: str, default: str, top: int | None = None) -> DataFrame:
    """Counts of a column's values with their percentage of all rows, largest first; null counts as ``default``."""
    counted = rows.select(F.coalesce(column, F.lit(default)).alias(column)).groupBy(column).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    shared = counted.crossJoin(F.broadcast(total)).select(column, "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))
    ordered = shared.orderBy(F.desc("n"), column)
    return ordered.limit(top) if top else ordered


def label_counts(rows: DataFrame, labels: str, top: int | None = None) -> DataFrame:
    """Counts of the values of an array column, largest first."""
    counted = rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
    return counted.limit(top) if top else counted


def quality_summary(intents: DataFrame) -> DataFrame:
    """Mean score, low scores among clause-level intents, and three buckets over all."""
    q = F.col("quality_score")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return intents.agg(
        F.round(F.avg(q), 9).alias("mean_score"), count((q < 0.8) & F.col("item_no").isNull()).alias("n_low"),
        count(q > 0.9).alias("n_high"), count((q >= 0.8) & (q <= 0.9)).alias("n_middle"), count(q < 0.8).alias("n_below"),
    )


def avg_intents_per_clause(chunks: DataFrame, intents: DataFrame) -> DataFrame:
    """Intents divided by clauses; null without clauses."""
    both = chunks.agg(F.count("*").alias("c")).crossJoin(F.broadcast(intents.agg(F.count("*").alias("i"))))  # one row each
    return both.select(F.round(F.try_divide("i", "c"), 9).alias("avg_intents"))


def token_usage_summary(answers: DataFrame) -> DataFrame:
    """Questions, total tokens (missing counts as 0) and their mean, which is null without questions."""
    tokens = F.coalesce(F.col("usage.total_tokens"), F.lit(0))
    return answers.agg(F.count("*").alias("n_questions"), F.coalesce(F.sum(tokens), F.lit(0)).alias("total_tokens"), F.round(F.avg(tokens), 6).alias("avg_tokens"))
