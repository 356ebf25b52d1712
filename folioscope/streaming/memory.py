"""Conversation memory as a stream: the last turns of every conversation as keyed state.

Messages (conv_id, turn, role, text) come in files; a conversation's messages arrive
in the order of their turns from one trigger to the next, in any order within one.
State holds the last message and the last ``keep`` answered turns of a conversation,
each no longer than memory shows of it.  With ``silence_ms`` a conversation of which
no file has told for longer, by the times of the files, starts anew, and its state
goes as soon as other files are that much newer.  Each trigger appends a row for every conversation that it
changed: (conv_id, last_turn, turns, memory).  :func:`current_memory` is the newest.

Edge cases: a message that comes again, or late, is not newer than the last one and
changes nothing, so a stream that is run again gives the same; messages without a
conversation, turn or role are left out; system messages are not part of a
conversation; a conversation without an answered turn has no memory row to show.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.memory import MEMORY_CHARS, TURNS, memory_text
from ..sources.store import pattern

MESSAGES = "conv_id long, turn long, role string, text string"
_TURNS = "array<struct<turn:long,question:string,answer:string>>"
CHANGED = f"conv_id long, last_turn long, turns {_TURNS}"
OUT = f"{CHANGED}, memory string, batch long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastTurns(StatefulProcessor):
    """Pairs each answer with the question right before it, and keeps the last pairs."""

    def __init__(self, keep: int, silence_ms: int | None):
        self.keep, self.silence_ms = keep, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pairs = handle.getListState("pairs", "turn long, question string, answer string")
        self.last = handle.getValueState("last", "turn long, role string, text string, arrived long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        messages = pd.concat(list(rows)).sort_values(["turn", "role", "text"])  # of one conversation in one trigger
        last = tuple(self.last.get()) if self.last.exists() else None
        pairs = [tuple(p) for p in self.pairs.get()] if self.pairs.exists() else []
        if last and self.silence_ms:
            self.handle.deleteTimer(last[3] + self.silence_ms)
        for turn, role, text, arrived in zip(messages["turn"].tolist(), messages["role"], messages["text"], messages["arrived"].tolist()):
            if last and turn <= last[0]:
                continue
            if last and self.silence_ms and arrived - last[3] > self.silence_ms:
                pairs, last = [], (last[0], None, None, arrived)
            if last and last[1] == "user" and role == "assistant" and text:
                pairs = [*pairs, (last[0], last[2], text)][-self.keep :]
            last = (turn, role, text, max(arrived, last[3] if last else arrived))
        self.last.update(last)
        self.pairs.put(pairs) if pairs else self.pairs.clear()
        if self.silence_ms:
            self.handle.registerTimer(last[3] + self.silence_ms)
        shown = [{"turn": t, "question": q, "answer": a} for t, q, a in pairs]
        yield pd.DataFrame({"conv_id": [key[0]], "last_turn": [last[0]], "turns": [shown]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        self.last.clear()
        self.pairs.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "last_turn": [last[0]], "turns": [[]]})

    def close(self) -> None:
        pass


def stream_memory(messages: DataFrame, keep: int = TURNS, silence_ms: int | None = None) -> DataFrame:
    """(conv_id, last_turn, turns, memory) of conversations as they change; the session's state store must be RocksDB.

    ``messages`` may have ``arrived_at``, the time that silence is measured by.
    """
    said = messages.filter("conv_id IS NOT NULL AND turn IS NOT NULL AND role <> 'system'")
    arrived = F.unix_millis("arrived_at") if silence_ms else F.lit(0).cast("long")
    if silence_ms:
        said = said.withWatermark("arrived_at", "0 seconds")
    # Memory shows no more of a text than this, so no more is shuffled or kept.  The
    # watermark ends silences; its column stays behind, so no message is too late.
    said = said.select("conv_id", "turn", "role", F.left("text", F.lit(MEMORY_CHARS)).alias("text"), arrived.alias("arrived"))
    changed = said.groupBy("conv_id").transformWithStateInPandas(LastTurns(keep, silence_ms), CHANGED, "Update", "EventTime" if silence_ms else "None")
    return changed.withColumn("memory", memory_text(F.col("turns")))


def start_memory(spark: SparkSession, folder: str, out: str, checkpoint: str, keep: int = TURNS, silence_ms: int | None = None, files_per_trigger: int = 200) -> StreamingQuery:
    """Take in all files of messages that are not yet known, then stop.

    A trigger that is run again writes its partition again.
    """
    spark.createDataFrame([], OUT).write.mode("append").partitionBy("batch").parquet(out)  # there even if no file ever comes
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        files = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", "36500d").parquet(pattern(folder))
        if silence_ms:
            files = files.select("*", F.col("_metadata.file_modification_time").alias("arrived_at"))

        def write(rows: DataFrame, batch: int) -> None:
            rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

        # The query keeps the settings with which it starts.
        return stream_memory(files, keep, silence_ms).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def current_memory(spark: SparkSession, out: str) -> DataFrame:
    """(conv_id, memory) as :func:`folioscope.operators.memory.memory_context` gives it for all messages so far."""
    rows = spark.read.schema(OUT).parquet(out)
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("turns", "memory"), F.struct("batch", "last_turn")).alias("m"))
    return last.filter(F.size("m.turns") > 0).select("conv_id", "m.memory")
