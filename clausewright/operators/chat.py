"""Conversations: sessions, bounded history, and answers that know it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausewright.functions import hooks


def conversation_sessions(messages: DataFrame) -> DataFrame:
    """Drop blanks and what follows quit; ``clear`` opens a new session (column ``session``)."""
    word = F.lower(F.trim("content"))
    so_far = W.partitionBy("conv_id").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    user = F.col("role") == "user"
    rows = messages.filter(F.trim("content") != "").withColumns(
        {"session": F.sum(F.when(user & (word == "clear"), 1).otherwise(0)).over(so_far), "ended": F.max(F.when(user & word.isin("quit", "exit", "q"), 1).otherwise(0)).over(so_far)}
    )
    return rows.filter((F.col("ended") == 0) & ~(user & (word == "clear"))).drop("ended")


def conversation_history(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Each message with the up to ``limit`` messages before it in its session, oldest first."""
    before = W.partitionBy("conv_id", "session").orderBy("seq").rowsBetween(-limit, -1)
    history = F.collect_list(F.struct("role", "content")).over(before)
    return messages.withColumn("history", history).withColumn("conversation_length", F.floor(F.least(F.size("history") + 1, F.lit(limit)) / 2))


def answer_rounds(rounds: DataFrame, generate: hooks.Generate, system: str, limit: int = 20, attempts: int = 1) -> DataFrame:
    """(conv_id, session, seq, query, content, usage, error, n_history, conversation_length), one row for each round.

    ``rounds`` are (conv_id, session, seq, query, prompt): what the user asked, and the prompt with its context. The model is sent the system message, the last ``limit`` messages
    of the session (questions without their context, and answers) and the prompt. Rounds of a session go in order of seq, as each needs the answers before it; a
    round that fails keeps its row and leaves no trace in the history. Rows are sorted within partitions and read one after another, so a task holds one history,
    never a whole conversation.
    """
    kept = rounds.select("conv_id", F.coalesce("session", F.lit(0)).cast("long").alias("session"), "seq", "query", "prompt")
    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    schema = f"conv_id {kind['conv_id']}, session long, seq {kind['seq']}, query string, {hooks.ANSWER}, n_history long, conversation_length long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, past = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.conv_id, r.session) != now:
                    now, past = (r.conv_id, r.session), []
                said = [{"role": "system", "content": system}, *past, {"role": "user", "content": r.prompt}]
                content, usage, error = hooks.ask(generate, said, attempts)
                before = len(past)
                if error is None:
                    past = [*past, {"role": "user", "content": r.query}, {"role": "assistant", "content": content}][-limit:]
                out.append((r.conv_id, r.session, r.seq, r.query, content, usage, error, before, len(past) // 2))
            yield pd.DataFrame(out, columns=["conv_id", "session", "seq", "query", "content", "usage", "error", "n_history", "conversation_length"])

    n = int(rounds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(n, "conv_id", "session").sortWithinPartitions("conv_id", "session", "seq").mapInPandas(run, schema)
