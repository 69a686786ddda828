"""Stateful streams against loops: batches, restarts, repeated and late rows, timers."""

from datetime import datetime, timedelta

from scriptorium.plans.workflows import stub
from scriptorium.streaming import stateful

START = datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, event_id long, status string, output boolean"


def arrive(spark, root, rows, patience=None, delay="60 seconds", kept=3):
    """One more file of events, and one more run of the stream from its checkpoint."""
    spark.createDataFrame([(k, START + timedelta(seconds=s), e, st, o) for k, s, e, st, o in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")
    states = stateful.file_states(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), delay, patience, kept)
    stateful.drain(spark, states, f"{root}/out", f"{root}/progress")
    return {r["key"]: (r["status"], r["chunks_done"], r["outputs"]) for r in stateful.newest(spark, f"{root}/out").collect()}


def test_states_go_on_after_a_restart_and_repeated_events_count_once(spark, tmp_path):
    first = [(1, 0, 10, "pending", False), (1, 5, 11, "processing", False), (2, 1, 12, "completed", True), (1, 6, 13, "processing", True), (1, 6, 13, "processing", True)]
    assert arrive(spark, tmp_path, first) == {1: ("processing", 2, [13]), 2: ("completed", 0, [12])}
    second = [(1, 5, 11, "processing", False), (1, 4, 14, "failed", True), (1, 9, 15, "completed", True), (1, 9, 16, None, True), (3, 9, 17, "skipped", None)]
    found = arrive(spark, tmp_path, second)
    assert found == {1: ("pending", 2, [16, 15, 13]), 2: ("completed", 0, [12]), 3: ("skipped", 0, [])}
    assert arrive(spark, tmp_path, first) == found


def test_late_events_are_dropped_and_silent_files_fail(spark, tmp_path):
    how = {"patience": 100_000, "delay": "10 seconds"}
    assert arrive(spark, tmp_path, [(1, 0, 1, "processing", False), (2, 50, 2, "processing", False)], **how)[1] == ("processing", 1, [])
    found = arrive(spark, tmp_path, [(2, 120, 3, "processing", True), (1, 5, 4, "completed", True)], **how)
    assert found == {1: ("failed", 1, []), 2: ("processing", 2, [3])}  # the event at 5 is behind the watermark, and at 110 file 1 has been silent for 100
    assert arrive(spark, tmp_path, [(1, 125, 5, "completed", True)], **how)[1] == ("completed", 1, [5])


def test_memory_reads_each_chunk_once(spark, tmp_path):
    chunks = [(k, p, f"text {k} {p}" if p != 2 else None) for k in (1, 2) for p in range(5)]
    schema = "key long, place int, text string"
    for part in ([c for c in chunks if c[1] < 2], chunks, chunks[:3]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = stateful.memory(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda text, history: ([text], stub(history + text)), forget_ms=3_600_000)
        stateful.drain(spark, rows, f"{tmp_path}/out", f"{tmp_path}/progress", "append", single=True)
    want, history = [], {1: "", 2: ""}
    for k, p, text in chunks:
        history[k] = stub(history[k] + (text or ""))
        want.append((k, p, [text or ""], history[k]))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
