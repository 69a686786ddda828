"""State of files and memory of documents as streams: each key's state is kept by Spark between batches and restarts."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: outputs that a job's log keeps.
KEPT_OUTPUTS = 200
#: Milliseconds of event time whose events are remembered, and forgotten, together.
SPAN = 7 * 86_400_000
_PROVIDER, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FileStates(StatefulProcessor):
    """One file's state from its events (ts in UTC milliseconds `at`, event_id, status, output).

    A value has the last event by (at, event_id) and the chunks done; a list the newest outputs; a map the events seen in each
    span of time, so that repeated ones count once. Events older than the watermark never come, so spans are forgotten behind it. A file that
    is processing and of which nothing is heard for `patience` milliseconds of event time has failed.
    """

    def __init__(self, kept: int, patience: int | None):
        self.kept, self.patience = kept, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "at long, event_id long, status string, done long")
        self.outputs = handle.getListState("outputs", "at long, event_id long")
        self.seen = handle.getMapState("seen", "span long", "ids array<long>")

    def _told(self, key: tuple, last: tuple, newest: list[tuple]) -> Row:
        return Row(key=key[0], at=last[0], status=last[2], chunks_done=last[3], outputs=[i for _, i in newest])

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        last = tuple(self.now.get()) if self.now.exists() else (-1, -1, "pending", 0)
        newest = [tuple(x) for x in self.outputs.get()] if self.outputs.exists() else []
        before, ids = last, {}
        for r in rows:
            span = r["at"] // SPAN
            if span not in ids:
                ids[span] = set(self.seen.getValue((span,))[0]) if self.seen.containsKey((span,)) else set()
            if r["event_id"] in ids[span]:
                continue
            ids[span].add(r["event_id"])
            done = last[3] + (r["status"] == "processing")
            last = (*max(last[:3], (r["at"], r["event_id"], r["status"])), done)
            if r["output"]:
                newest = heapq.nlargest(self.kept, [*newest, (r["at"], r["event_id"])])
        self.now.update(last)
        for span, own in ids.items():
            self.seen.updateValue((span,), (sorted(own),))
        if newest:
            self.outputs.put(newest)
        if self.patience is not None and last[:3] != before[:3]:
            if before[0] >= 0:
                self.handle.deleteTimer(before[0] + self.patience)
            self.handle.registerTimer(last[0] + self.patience)
        yield self._told(key, last, newest)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        behind = timerValues.getCurrentWatermarkInMs()
        for span in [k[0] for k in self.seen.keys() if (k[0] + 1) * SPAN <= behind]:
            self.seen.removeKey((span,))
        last = tuple(self.now.get())
        if last[2] == "processing" and last[0] + self.patience <= expiredTimerInfo.getExpiryTimeInMs():
            last = (last[0], last[1], "failed", last[3])
            self.now.update(last)
            yield self._told(key, last, [tuple(x) for x in self.outputs.get()] if self.outputs.exists() else [])

    def close(self) -> None:
        pass


def file_states(events: DataFrame, delay: str, patience_ms: int | None = None, kept: int = KEPT_OUTPUTS) -> DataFrame:
    """key, at, status, chunks_done and outputs of the files that a batch of events (key, ts, event_id, status, output) touches.

    Of one file every event id counts once; order doesn't matter up to the watermark's `delay`, and what is later than that is dropped. Null
    keys are a file, null status counts as pending. State grows with the files, and with the events of the last `delay`.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).select("key", "ts", (F.unix_micros("ts") / 1000).cast("long").alias("at"), "event_id", F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("output", F.lit(False)).alias("output"))
    kind = events.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(FileStates(kept, patience_ms), f"key {kind}, at long, status string, chunks_done long, outputs array<long>", "Update", "EventTime")


class Memory(StatefulProcessor):
    """One document's rolling memory: each chunk is read with the history that those before it left.

    `merged` remembers which chunks have been read, for `forget_ms` of processing time; a repeated chunk is passed over."""

    def __init__(self, extract: Callable[[str, str], tuple[list[str], str]], forget_ms: int | None):
        self.extract, self.forget_ms = extract, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.history = handle.getValueState("history", "text string")
        self.merged = handle.getMapState("merged", "place long", "done boolean", self.forget_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        history = self.history.get()[0] if self.history.exists() else ""
        for r in sorted(rows, key=lambda r: (r["place"], r["text"])):
            if self.merged.containsKey((r["place"],)):
                continue
            facts, history = self.extract(r["text"], history)
            self.merged.updateValue((r["place"],), (True,))
            yield Row(key=key[0], place=r["place"], facts=facts, history=history)
        self.history.update((history,))

    def close(self) -> None:
        pass


def memory(chunks: DataFrame, extract: Callable[[str, str], tuple[list[str], str]], forget_ms: int | None = None) -> DataFrame:
    """key, place, facts and history of new chunks (key, place, text), in the order of their places inside a batch.

    A chunk that comes in a later batch than its followers is read when it comes. Null texts are empty. A document's new
    chunks of one batch are in hand together; bound batches by files for long ones. With `forget_ms` the stream watches the clock, so it
    never has all that is there: drain it in single batches."""
    rows = chunks.select("key", F.col("place").cast("long").alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    kind = chunks.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Memory(extract, forget_ms), f"key {kind}, place long, facts array<string>, history string", "Append", "None" if forget_ms is None else "ProcessingTime")


def drain(spark: SparkSession, rows: DataFrame, target: str, progress: str, mode: str = "update", single: bool = False) -> None:
    """Run a stream over all that is there now, in one batch if `single`, and end. Changed rows (update) are written in versions, a batch that is run
    again replacing itself; rows that only come once (append) go to Parquet files. `progress` has the state and offsets.

    Keyed state of these streams needs the RocksDB store; the session's own choice is put back once the stream has begun.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = rows.writeStream.outputMode(mode).option("checkpointLocation", progress)
        writer = writer.trigger(once=True) if single else writer.trigger(availableNow=True)
        if mode == "append":
            stream = writer.format("parquet").option("path", target).start()
        else:
            stream = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{target}/version={number}")).start()
        stream.awaitTermination()
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def newest(spark: SparkSession, target: str, key: str = "key") -> DataFrame:
    """The last version of each key's row."""
    rows = spark.read.option("basePath", target).parquet(target)
    names = [c for c in rows.columns if c not in (key, "version")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), "version").alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in names])
