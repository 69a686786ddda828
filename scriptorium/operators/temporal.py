"""Joins and groups over time: sessions, the state in force at a time, and states rolled up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str, key: str = "key", ts: str = "ts", delay: str | None = None) -> DataFrame:
    """key, start, stop (the last event and the gap) and n of each run of events of a key that are less than `gap` apart.

    Of a stream with a `delay`, a session is told once, when the watermark has passed its stop, and later rows of it are
    dropped. Rows without a time are in no session; null keys are one key."""
    rows = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows if delay is None else rows.withWatermark("ts", delay)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count("*").alias("n"))
    return found.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def as_of(rows: DataFrame, states: DataFrame, span: str = "day", key: str = "key", ts: str = "ts") -> DataFrame:
    """Each row with `state`, the struct of the other columns of the last row of `states` of its key that is not later; null if there is none.

    Of states of one key and time the greatest struct counts. Both tables are laid together and read in order inside of one
    key and one span of time (`span`, as date_trunc has it), so that a hot key is many windows; the last state of each span is
    carried on over a key's spans, which are few. Rows without key or time have no state.
    """
    names = rows.columns
    others = [c for c in states.columns if c not in (key, ts)]
    kind = F.struct(*[F.col(c) for c in others])
    told = states.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), kind.alias("_state"))
    told = told.groupBy("_key", "_ts").agg(F.max("_state").alias("_state"))
    asked = rows.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.struct(*[F.col(c) for c in names]).alias("_row"))
    fit = F.col("_key").isNotNull() & F.col("_ts").isNotNull()
    both = asked.where(fit).withColumn("_state", F.lit(None).cast(told.schema["_state"].dataType)).unionByName(told.withColumn("_row", F.lit(None).cast(asked.schema["_row"].dataType)))
    both = both.withColumn("_span", F.date_trunc(span, F.col("_ts")))
    inside = Window.partitionBy("_key", "_span").orderBy("_ts", F.col("_row").isNotNull())
    own = both.withColumn("_now", F.last("_state", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_row is not null")
    ends = told.withColumn("_span", F.date_trunc(span, F.col("_ts"))).groupBy("_key", "_span").agg(F.max_by("_state", "_ts").alias("_end"))
    spans = both.select("_key", "_span").distinct().join(ends, ["_key", "_span"], "left")
    carried = spans.select("_key", "_span", F.last("_end", True).over(Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    found = own.join(carried, ["_key", "_span"], "left").select("_row.*", F.coalesce("_now", "_before").alias("state"))
    return found.unionByName(asked.where(~fit).select("_row.*", F.lit(None).cast(told.schema["_state"].dataType).alias("state")))


def rolled_up(rows: DataFrame, by: list[Column], names: list[str], measures: list[Column]) -> DataFrame:
    """Measures for each combination of the columns, for each shorter list of them, and for all rows; `level` tells which
    columns a row is summed over (grouping_id), so that a null of the data isn't taken for a total."""
    keyed = rows.select("*", *[c.alias(f"_{n}") for c, n in zip(by, names)])
    found = keyed.rollup(*[f"_{n}" for n in names]).agg(F.grouping_id().cast("long").alias("level"), *measures)
    return found.select(*[F.col(f"_{n}").alias(n) for n in names], *[c for c in found.columns if c not in {f"_{n}" for n in names}])


def overlapping(left: DataFrame, right: DataFrame, width: int = 4096, key: str = "key") -> DataFrame:
    """All columns of both (key, start, stop and others; those of the right with `_right`) for each pair of spans of a key
    that have a place in common; stop isn't part of a span.

    Spans are laid into buckets of `width` places and joined by key and bucket; a pair that shares several buckets counts
    in the first of them only. So a document's spans are compared in as many groups as it has buckets. Empty, reversed
    and null spans touch nothing; repeated ones stay repeated.
    """
    def laid(df: DataFrame) -> DataFrame:
        fit = df.where(F.col(key).isNotNull() & (F.col("start") < F.col("stop")))
        return fit.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))

    other = laid(right)
    other = other.select(key, "_bucket", *[F.col(c).alias(f"{c}_right") for c in right.columns if c != key])
    both = laid(left).join(other, [key, "_bucket"])
    first = F.floor(F.greatest("start", "start_right") / width)
    return both.where((F.col("start") < F.col("stop_right")) & (F.col("start_right") < F.col("stop")) & (F.col("_bucket") == first)).drop("_bucket")
