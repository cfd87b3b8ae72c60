"""Structured Streaming: retrieval of arriving questions, and the bounded history of conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

HISTORY = "conv_id long, seq long, role string, content string, history array<struct<role:string,content:string>>"


def stream_retrieve(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of questions through ``retrieve`` against its static index, as Parquet under ``path``/batch=N.

    A batch that is repeated after a failure overwrites its own folder, so every question is answered once.
    """

    def answer(batch: DataFrame, number: int) -> None:
        retrieve(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Follow(StatefulProcessor):
    """The state of a conversation: a list of its last messages, and whether it has ended."""

    def __init__(self, limit: int):
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "role string, content string")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ended, past = self.ended.exists(), [tuple(r) for r in self.past.get()]
        had, was, out = past, ended, []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples():
            said = (row.content or "").strip(" ")
            word = said.lower() if row.role == "user" else ""
            if ended or not said:
                continue
            if word in ("quit", "exit", "q"):
                ended = True
            elif word == "clear":
                past = []
            else:
                out.append((key[0], row.seq, row.role, row.content, [{"role": r, "content": c} for r, c in past]))
                past = [*past, (row.role, row.content)][-self.limit :]
        if past != had:
            self.past.put(past) if past else self.past.clear()
        if ended and not was:
            self.ended.update((True,))
        yield pd.DataFrame(out, columns=["conv_id", "seq", "role", "content", "history"])

    def close(self) -> None:
        pass


def stream_history(messages: DataFrame, limit: int = 20) -> DataFrame:
    """Each kept message with the up to ``limit`` messages before it in its session, over all micro-batches.

    Within a micro-batch messages count by seq. Blank messages are skipped, ``clear`` of a user empties the history, quit, exit or q of a user ends the
    conversation. State is kept as Spark's own lists and values, which need the RocksDB store; the session is told to use it.
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = messages.select("conv_id", "seq", "role", "content")
    return rows.groupBy("conv_id").transformWithStateInPandas(_Follow(limit), HISTORY, "Append", "None")
