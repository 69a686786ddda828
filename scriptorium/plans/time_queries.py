"""Queries over time and spans: sessions, states in force, roll-ups, and what chunks touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import text_pieces
from scriptorium.operators import chunking, temporal
from scriptorium.plans import sql
from scriptorium.plans.chunk_queries import markdown
from scriptorium.plans.registry import query
from scriptorium.plans.state_queries import _STATUS, _events
from scriptorium.sources.tables import load
from scriptorium.streaming import ingest as streams

_SESSIONS = """with e as (select user_id as key, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as begins from events where ts is not null),
    s as (select key, ts, sum(begins) over (partition by key order by ts) as s from e),
    g as (select key, min(ts) as start, max(ts) + interval 6 hours as stop, count(*) as n from s group by key, s)
    select key, epoch_us(start) as start_us, epoch_us(stop) as stop_us, n from g"""


def _told(found: DataFrame) -> DataFrame:
    return found.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("stop").alias("stop_us"), "n")


@query(_SESSIONS)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(temporal.sessions(load(spark, sf_dir, "events"), "6 hours", "user_id"))


@query(f"{_SESSIONS} where epoch_ms(stop) <= (select epoch_ms(max(ts)) - 24 * 3600000 from events)")
def closed_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream of events, each written once when it is over; those that the watermark hasn't passed stay open."""
    events = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    root = streams.shared_folder(spark)
    events.write.parquet(f"{root}/in")
    rows = temporal.sessions(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "6 hours", "user_id", delay="24 hours")
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return _told(spark.read.schema(rows.schema).parquet(f"{root}/out"))


@query(f"""with v as (select * from events where event_type = 'view'), s as (select user_id, ts, max(event_id) as since, arg_max({_STATUS}, event_id) as status from events where event_type <> 'view' group by user_id, ts)
    select v.event_id, s.status, s.since from v asof left join s on v.user_id = s.user_id and v.ts >= s.ts""")
def status_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view of a user the status that their events had given them by then, and the event that gave it."""
    events = _events(spark, sf_dir)
    views = events.where("status = 'skipped'").select("key", "ts", "event_id")
    found = temporal.as_of(views, events.where("status <> 'skipped'").select("key", "ts", F.col("event_id").alias("since"), "status"))
    return found.select("event_id", "state.status", "state.since")


@query(f"""select source, lang, day, grouping_id(source, lang, day)::bigint as level, count(*) as n, count(*) filter (where status = 'failed') as n_failed, count(distinct doc_id) as n_docs
    from (select source, lang, ts::date::varchar as day, {_STATUS} as status, doc_id from events join documents on doc_id = user_id) group by rollup (source, lang, day)""")
def state_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of documents by source, language and day, with all totals."""
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "lang")
    rows = _events(spark, sf_dir).join(docs, "key")
    measures = [F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_distinct("key").alias("n_docs")]
    return temporal.rolled_up(rows, [F.col("source"), F.col("lang"), F.to_date("ts").cast("string")], ["source", "lang", "day"], measures)


@query(f"""with l as ({sql.LINES}), m as (select *, row_number() over (partition by conv_id order by line) - 1 as n from l where starts_with(trim(content), '```')),
    f as (select conv_id, n // 2 as span, min(start_at) as start, max(start_at + length(content) + 1) as stop from m group by conv_id, n // 2 having count(*) = 2),
    p as (select conv_id, unnest(range((length(text) + 299) // 300)) as piece, length(text) as chars from ({sql.VIEW}))
    select p.conv_id, piece::int as piece, span::int as fence, (least(stop, least((piece + 1) * 300, chars)) - greatest(start, piece * 300))::int as chars from p join f on f.conv_id = p.conv_id and start <= least((piece + 1) * 300, chars) - 1 and piece * 300 <= stop - 1""")
def touched_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each piece of 300 code points the code fences that it touches, and how much of them it has."""
    docs = markdown(spark, sf_dir)
    pieces = docs.select(F.col("conv_id").alias("key"), F.length("text").alias("chars"), F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / 300).cast("int")))).alias("piece"))
    pieces = pieces.select("key", "piece", (F.col("piece") * 300).alias("start"), F.least((F.col("piece") + 1) * 300, "chars").alias("stop"))
    fences = chunking.fence_spans(docs, "conv_id").select(F.col("conv_id").alias("key"), "span", "start", "stop")
    both = temporal.overlapping(pieces, fences, 1024)
    return both.select(F.col("key").alias("conv_id"), "piece", F.col("span_right").alias("fence"), (F.least("stop", "stop_right") - F.greatest("start", "start_right")).cast("int").alias("chars"))


@query("""with recursive t as (select doc_id, text, length(text) as n from documents where text is not null),
    p as (select doc_id, text, n, 0 as piece, 0 as spot, case when n <= 500 then n else 0 end as size from t where n <= 500
      union all select doc_id, text, n, 0, 0, case when b > 250 and b < 499 then b else 500 end from (select *, 500 - strpos(reverse(text[1:500]), chr(10) || chr(10)) - 1 as b from t where n > 500)
      union all select doc_id, text, n, piece + 1, spot + size, case when spot + size + 500 < n and b > 250 and b < 499 then b else least(500, n - spot - size) end
        from (select *, 500 - strpos(reverse(text[spot + size + 1:spot + size + 500]), chr(10) || chr(10)) - 1 as b from p where spot + size < n))
    select doc_id, piece, spot::int as "at", md5(text[spot + 1:spot + size]) as digest from p""")
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in pieces of 500 code points, cut at a blank line beyond the first half of a piece."""
    return text_pieces(load(spark, sf_dir, "documents").select("doc_id", "text"), 500).select("doc_id", "piece", "at", F.md5(F.col("body").cast("binary")).alias("digest"))
