"""State of files and jobs: queues, counts, bounded logs and progress, from event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import redacted_json

STATUSES = ["pending", "processing", "completed", "failed", "skipped"]
RESUMABLE = ["pending", "processing", "failed"]


def latest(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last event of each key; one row for each key and task is shuffled."""
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return last.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def registered(state: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """State with the keys that it lacks as pending, and without those that aren't among the keys."""
    return keys.select(key).distinct().join(state, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))


def queue(state: DataFrame, interrupted: Column, order: list[str]) -> DataFrame:
    """What is to be processed, an interrupted file first; unknown status counts as pending."""
    return state.where(F.coalesce("status", F.lit("pending")).isin(RESUMABLE)).orderBy(F.when(interrupted, 0).otherwise(1), *order)


def stats(state: DataFrame) -> DataFrame:
    return state.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def pruned(state: DataFrame, keep: int, newest: list[Column], key: str = "key") -> DataFrame:
    """State without all but the newest `keep` completed keys."""
    stay = state.where("status = 'completed'").orderBy(*newest).limit(keep).select(key)
    return state.where("status <> 'completed'").unionByName(state.where("status = 'completed'").join(F.broadcast(stay) if keep <= 10_000 else stay, key, "left_semi"))


def requeued(state: DataFrame, counters: tuple[str, ...] = ()) -> DataFrame:
    """State to begin anew: what was begun, failed or completed is pending again, with its counters at zero."""
    again = F.col("status").isin("processing", "failed", "completed")
    zeroed = {c: F.when(again, F.lit(0)).otherwise(F.col(c)) for c in counters}
    return state.withColumns({**zeroed, "status": F.when(again, "pending").otherwise(F.col("status"))})


def last_of_each(events: DataFrame, key: str, newest: list[Column], n: int) -> DataFrame:
    """The newest n events of each key, with their rank."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*newest))
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


def rolling_facts(facts: DataFrame, key: str, order: list[str], kept=("high", "medium"), facts_kept: int = 10, headings_kept: int = 3) -> DataFrame:
    """For each row the last facts of some confidence and the last headings up to it, as a block of text.

    Kept facts are numbered, so that a window over their numbers holds a few rows, however long a key's history is.
    """
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = facts.withColumn("_n", F.count_if(F.col("confidence").isin(*kept)).over(so_far))
    near = Window.partitionBy(key).orderBy("_n").rangeBetween(-(facts_kept - 1), 0)
    told = F.when(F.col("confidence").isin(*kept), F.struct(F.col("_n").alias("n"), F.col("claim").alias("claim")))
    heads = F.collect_list("heading").over(Window.partitionBy(key).orderBy(*order).rowsBetween(-(headings_kept - 1), 0))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(told).over(near)), lambda x: F.concat(F.lit("\n- "), x["claim"])), "")
    return numbered.withColumn("context", F.concat(F.array_join(heads, " → "), lines)).drop("_n")


def merged_buckets(old: Column, new: Column) -> Column:
    """Old items, then new ones that aren't there yet."""
    return F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))


def resume_index(status: Column, done: Column) -> Column:
    """The chunk to go on with: what a file in processing has done, else the first."""
    return F.when(status == "processing", done).otherwise(0)


def failed(state: DataFrame, is_failed: Column, error: Column) -> DataFrame:
    """State with some rows marked as failed, and the first 500 code points of their error."""
    return state.withColumn("error", F.when(is_failed, F.substring(error, 1, 500))).withColumn("status", F.when(is_failed, "failed").otherwise(F.col("status")))


def recorded(calls: DataFrame, key: str, newest: list[Column], payloads: list[str], most: int = 5) -> DataFrame:
    """The newest calls of each key with their rank; secrets in their payloads (JSON) are masked, and what is too long is cut.
    Only what stays is read by the masking function."""
    kept = last_of_each(calls, key, newest, most)
    return kept.withColumns({p: redacted_json(F.col(p)) for p in payloads})


def kept_facts(facts: DataFrame, key: str, newest: list[Column], kept=("high", "medium"), most: int = 20) -> DataFrame:
    """The last facts of some confidence that a key's memory keeps, with their rank from the newest."""
    return last_of_each(facts.where(F.col("confidence").isin(*kept)), key, newest, most)
