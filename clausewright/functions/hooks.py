"""Adapters for caller-supplied, batch-wise functions: encoders, pair scorers and text generators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], np.ndarray]
ScorePairs = Callable[[list[str], list[str]], Sequence[float]]
Generate = Callable[[list[dict]], tuple[str, dict]]

ANSWER = "content string, usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>, error string"
#: The error of a reply that was refused each time.
REFUSED = "malformed reply"


def encoder(encode: Encode) -> Callable[[Column], Column]:
    """A column function from text to array<double>; null texts are encoded as empty ones."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.asarray(encode(texts.fillna("").tolist()), np.float64) if len(texts) else []
            yield pd.Series(list(rows), dtype=object)

    return run


def pair_scorer(score: ScorePairs) -> Callable[[Column, Column], Column]:
    """A column function from (query, document) to a score."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, docs in batches:
            found = score(queries.fillna("").tolist(), docs.fillna("").tolist()) if len(queries) else []
            yield pd.Series(np.asarray(found, np.float64))

    return run


def ask(generate: Generate, said: list[dict], attempts: int = 3, accept: Callable[[str], bool] | None = None) -> tuple[str | None, dict | None, str | None]:
    """(content, usage, error) of a call that is made again if it fails or its content is refused; after ``attempts`` the error's text is left."""
    error = None
    for _ in range(attempts):
        try:
            content, usage = generate(said)
            if accept and not accept(content):
                raise ValueError(REFUSED)
            return content, {k: int((usage or {}).get(k, 0)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}, None
        except Exception as e:  # any failure of a caller's client becomes an error row
            error = str(e)
    return None, None, error


def generate_replies(rows: DataFrame, generate: Generate, messages: str = "messages", attempts: int = 3, tasks: int | None = None, accept: Callable[[str], bool] | None = None) -> DataFrame:
    """``rows`` without their messages, with content, usage and error.

    A call that fails, or whose content ``accept`` refuses, is made again; one that fails ``attempts`` times gives null content and the error's text; it never fails the job. ``tasks`` spreads slow
    calls over so many tasks.
    """
    spread = rows.repartition(tasks) if tasks else rows
    keep = [c for c in rows.columns if c != messages]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != messages) + ", " + ANSWER

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = [ask(generate, [{"role": m["role"], "content": m["content"]} for m in said], attempts, accept) for said in batch[messages]]
            out = batch[keep].copy()
            for at, name in enumerate(("content", "usage", "error")):
                out[name] = pd.Series([r[at] for r in replies], index=out.index, dtype=object)
            yield out

    return spread.mapInPandas(run, schema)


def durable_replies(
    rows: DataFrame, generate: Generate, path: str, messages: str = "messages", attempts: int = 3, tasks: int | None = None, accept: Callable[[str], bool] | None = None, waves: int = 16
) -> DataFrame:
    """As ``generate_replies``, but each different prompt is asked once, and replies are kept in a table under ``path`` by the hash of their prompt.

    Prompts without a reply there are asked in ``waves``, each of which is appended when it ends; a run that breaks and starts again asks only
    what no ended wave has answered. Failed and malformed replies are not kept: they are asked for again by the next run.
    """
    spark = rows.sparkSession
    schema = f"prompt_hash string, {ANSWER}"
    marked = rows.withColumn("prompt_hash", F.sha2(F.to_json(F.struct(messages)).cast("binary"), 256))
    mark = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = mark.getFileSystem(spark._jsc.hadoopConfiguration())
    read = lambda: spark.read.schema(schema).parquet(path)
    if not files.exists(mark):
        spark.createDataFrame([], schema).write.parquet(path)
    asked = marked.select("prompt_hash", messages).dropDuplicates(["prompt_hash"])
    failed = None
    for wave in range(waves):
        part = asked.filter(F.pmod(F.xxhash64("prompt_hash"), F.lit(waves)) == wave).join(read().select("prompt_hash"), "prompt_hash", "left_anti")
        replies = generate_replies(part, generate, messages, attempts, tasks, accept)
        step = f"{path}_waves/{wave}"
        replies.write.mode("overwrite").parquet(step)  # all calls of the wave have ended before anything is read from it
        done = spark.read.schema(schema).parquet(step)
        done.filter("error is null").write.mode("append").parquet(path)
        failed = done.filter("error is not null") if failed is None else failed.unionByName(done.filter("error is not null"))
    answers = read().dropDuplicates(["prompt_hash"])
    return marked.drop(messages).join(answers.unionByName(failed), "prompt_hash", "left").drop("prompt_hash")


def malformed(replies: DataFrame) -> DataFrame:
    """(n_replies, n_malformed, n_failed): how many replies there are, were refused each time, and failed otherwise."""
    refused = F.col("error") == REFUSED
    return replies.agg(F.count("*").alias("n_replies"), F.count(F.when(refused, 1)).alias("n_malformed"), F.count(F.when(F.col("error").isNotNull() & ~refused, 1)).alias("n_failed"))
