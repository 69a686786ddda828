"""Sessions, as-of joins, roll-ups, overlapping spans and pieces of texts against plain versions."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scriptorium.functions.text import pieces_of, text_pieces
from scriptorium.operators import temporal

START = datetime(2024, 3, 1)


def at(hours):
    return None if hours is None else START + timedelta(hours=hours)


def test_as_of_is_the_last_state_not_later(spark):
    rng = random.Random(8)
    states = [(rng.choice(["a", "b", None]), at(rng.choice([None, *range(0, 200, 7)])), i, f"s{i}") for i in range(60)]
    rows = [(i, rng.choice(["a", "b", "c", None]), at(rng.choice([None, *range(0, 220, 5)])), None) for i in range(80)]
    rows += rows[:5]
    found = temporal.as_of(spark.createDataFrame(rows, "id int, key string, ts timestamp, state string").drop("state"), spark.createDataFrame(states, "key string, ts timestamp, n int, name string"))
    want = []
    for i, key, ts, _ in rows:
        own = [(s[1], s[2], s[3]) for s in states if key is not None and ts is not None and s[0] == key and s[1] is not None and s[1] <= ts]
        want.append((i, max(own)[1:] if own else None))
    assert sorted(map(str, want)) == sorted(str((r["id"], tuple(r["state"]) if r["state"] else None)) for r in found.collect())
    assert temporal.as_of(spark.createDataFrame(rows, "id int, key string, ts timestamp, s string").limit(0), spark.createDataFrame(states, "key string, ts timestamp, n int, name string")).count() == 0


def test_late_rows_of_a_stream_are_in_no_session(spark, tmp_path):
    schema = "key string, ts timestamp"
    def drained(rows):
        spark.createDataFrame([(k, at(h)) for k, h in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = temporal.sessions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "2 hours", delay="3 hours")
        found.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["key"], (r["start"] - START).total_seconds() / 3600, (r["stop"] - START).total_seconds() / 3600, r["n"]) for r in spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())

    assert drained([("a", 0), ("a", 1), ("b", 1.5), ("a", 9)]) == [("a", 0, 3, 2), ("b", 1.5, 3.5, 1)]  # the watermark is at 6
    assert drained([("a", 2), ("a", 7.5), ("a", 20), ("b", None)]) == [("a", 0, 3, 2), ("a", 7.5, 11, 2), ("b", 1.5, 3.5, 1)]  # 2 is late, 7.5 joins 9


def test_totals_are_told_from_nulls(spark):
    rows = spark.createDataFrame([("x", None, 1), ("x", "d", 2), (None, "d", 4)], "a string, b string, n int")
    found = temporal.rolled_up(rows, [F.col("a"), F.col("b")], ["a", "b"], [F.sum("n").alias("total")])
    assert found.columns == ["a", "b", "level", "total"]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, [("x", None, 0, 1), ("x", "d", 0, 2), (None, "d", 0, 4), ("x", None, 1, 3), (None, None, 1, 4), (None, None, 3, 7)]))


def test_overlapping_spans_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    spans = lambda n: [(rng.choice(["k", "l", None]), s, s + rng.choice([-3, 0, 1, 5, 40, 300]), i) for i in range(n) for s in [rng.randrange(400)]]
    left, right = spans(50), [*spans(50), ("k", None, 7, 99)]
    want = sorted((a[3], b[3]) for a in left for b in right if a[0] is not None and a[0] == b[0] and b[1] is not None and a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2])
    tables = [spark.createDataFrame(x, "key string, start int, stop int, n int") for x in (left, right)]
    for width in (1, 16, 4096):
        found = temporal.overlapping(*tables, width)
        assert sorted((r["n"], r["n_right"]) for r in found.collect()) == want


def test_pieces_of_a_long_text_take_linear_time(spark):
    text = ("word " * 40 + "\n\n") * 50_000
    began = time.time()
    parts = pieces_of(text, 1000)
    assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p for a, p in parts[:100]) and time.time() - began < 5
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ab\n\ncdefg")], "doc_id long, text string")
    found = text_pieces(docs.where("doc_id > 1"), 5)
    assert [(r["piece"], r["at"], r["body"]) for r in found.where("doc_id = 4").orderBy("piece").collect()] == [(0, 0, "ab\n\nc"), (1, 5, "defg")]
    assert found.where("doc_id = 3").count() == 1 and found.where("doc_id = 2").count() == 0 and text_pieces(docs, 1000).where("doc_id = 1").count() == len(parts)
