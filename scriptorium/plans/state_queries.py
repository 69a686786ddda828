"""Queries of state, queues, logs, rolling context and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.budgets import percent
from scriptorium.operators import dedup, state
from scriptorium.plans import sql, workflows
from scriptorium.plans.registry import query
from scriptorium.sources.tables import load
from scriptorium.streaming import ingest as streams
from scriptorium.streaming import progress, stateful

_STATUS = "case event_type when 'signup' then 'pending' when 'error' then 'failed' when 'click' then 'processing' when 'purchase' then 'completed' else 'skipped' end"
_LATEST = f"(select user_id as key, ts, event_id, {_STATUS} as status from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in (("signup", "pending"), ("error", "failed"), ("click", "processing"), ("purchase", "completed")) for x in pair])
    return load(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts", "event_id", F.coalesce(kind[F.col("event_type")], F.lit("skipped")).alias("status"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(_events(spark, sf_dir), "key", ["ts", "event_id"])


@query(f"select {', '.join(f'''count(*) filter (where status = '{s}') as {s}''' for s in state.STATUSES)}, count(*) as total from {_LATEST}")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.stats(_latest(spark, sf_dir))


@query(f"select key, status from {_LATEST} where status in ('pending', 'processing', 'failed')")
def queue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.queue(_latest(spark, sf_dir), F.col("key") % 10 == 0, ["ts", "key"]).select("key", "status")


@query(f"select key, status from {_LATEST} qualify status <> 'completed' or row_number() over (partition by status order by ts desc, key) <= 20")
def prune_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.pruned(_latest(spark, sf_dir), 20, [F.desc("ts"), F.col("key")]).select("key", "status")


@query(f"select key, case when status in ('processing', 'failed', 'completed') then 'pending' else status end as status from {_LATEST}")
def requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.requeued(_latest(spark, sf_dir)).select("key", "status")


@query(f"select c_custkey as key, coalesce(status, 'pending') as status from customer left join {_LATEST} on key = c_custkey")
def register_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.registered(_latest(spark, sf_dir), load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))).select("key", "status")


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 500")
def bounded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)


@query("select event_type, event_id, rank from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc)::int as rank from events) where rank <= 5")
def last5_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_of_each(load(spark, sf_dir, "events"), "event_type", [F.desc("ts"), F.desc("event_id")], 5).select("event_type", "event_id", "rank")


@query("""select user_id, case when count(*) > 0 then least(100, round_even(count(*) filter (where event_type in ('purchase', 'view')) / count(*) * 100, 0)::int) else 0 end as percent from events group by user_id""")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type").isin("purchase", "view")).alias("done"), F.count("*").alias("total"))
    return counts.select("user_id", percent(F.col("done"), F.col("total"), 100).alias("percent"))


@query("""select conv_id, turn, md5(array_to_string(list(role) over (partition by conv_id order by turn rows between 2 preceding and current row), ' → ') || coalesce(array_to_string(list_transform(
        list_reverse(list_reverse(list_filter(list(case when role <> 'system' then coalesce(text, '')[1:40] end) over (partition by conv_id order by turn), lambda x: x is not null))[1:10]), lambda x: chr(10) || '- ' || x), ''), '')) as digest from conversations""")
def rolling_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    confidence = F.when(F.col("role") == "system", "low").otherwise("high")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", confidence.alias("confidence"), F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("claim"), F.col("role").alias("heading"))
    return state.rolling_facts(rows, "conv_id", ["turn"]).select("conv_id", "turn", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("""select conv_id, array_to_string(list_concat(o, list_filter(n, lambda x: not list_contains(o, x))), ',') as roles from (select conv_id, list_sort(list_distinct(coalesce(list(role) filter (where turn % 2 = 0), []))) as o, list_sort(list_distinct(coalesce(list(role) filter (where turn % 2 = 1), []))) as n from conversations group by conv_id)""")
def rolling_structured_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of even turns, then those of odd turns that aren't there yet."""
    of = lambda k, name: F.array_sort(F.collect_set(F.when(F.col("turn") % 2 == k, F.col("role")))).alias(name)
    rows = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(of(0, "old"), of(1, "new"))
    return rows.select("conv_id", F.array_join(state.merged_buckets(F.col("old"), F.col("new")), ",").alias("roles"))


@query("""select coalesce(d.doc_id, m.doc_id) as doc_id, coalesce(case when quality = 1 then 'good' end, lang) as lang, coalesce(toxic, -1) as toxic
    from (select doc_id, lang from documents where doc_id % 3 > 0) d full join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) m on d.doc_id = m.doc_id""")
def map_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches change rows that are there and add those that aren't."""
    marks = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    patch = marks.select("doc_id", F.when(F.col("quality") == 1, "good").alias("lang"), "toxic")
    table = load(spark, sf_dir, "documents").where("doc_id % 3 > 0").select("doc_id", "lang", F.lit(-1).alias("toxic"))
    found = dedup.upsert(table, patch, "doc_id")
    return found.withColumn("toxic", F.coalesce("toxic", F.lit(-1)))


@query(f"select name, position, count(user_id) as n_events, count(distinct user_id) as n_users from (select unnest({workflows.CATALOG!r}) as name, unnest(range({len(workflows.CATALOG)}))::int as position) left join events on event_id % 11 = position group by name, position")
def workflow_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflows with the events and users that ask for each."""
    names = spark.createDataFrame(list(enumerate(workflows.CATALOG)), "position int, name string")
    asked = load(spark, sf_dir, "events").groupBy((F.col("event_id") % 11).cast("int").alias("position")).agg(F.count("user_id").alias("n_events"), F.count_distinct("user_id").alias("n_users"))
    return names.join(asked, "position", "left").fillna(0, ["n_events", "n_users"]).select("name", "position", "n_events", "n_users")


@query(f"select doc_id, lang, md5({sql.normalised('text')}) as digest, {sql.tokens("coalesce(text, '')")} as tokens from documents")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream over the table's files ends with what the batch plan gives."""
    root = streams.shared_folder(spark)
    streams.ingest(spark, f"{sf_dir}/documents.parquet", f"{root}/out", f"{root}/progress")
    return spark.read.parquet(f"{root}/out")


@query("select conv_id as key, max(turn) as chunks_done, max(length(coalesce(text, '')))::int as last from conversations group by conv_id")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as chunks that are done, followed as a stream; its table ends with what the batch plan gives."""
    root = streams.shared_folder(spark)
    columns = [F.col("conv_id").alias("key"), F.col("turn").alias("chunk"), F.length(F.coalesce("text", F.lit(""))).alias("at")]
    progress.follow(spark, f"{sf_dir}/conversations.parquet", f"{root}/out", f"{root}/progress", columns)
    return progress.latest(spark, f"{root}/out")


@query(f"""select user_id as key, l.status, count(*) filter (where {_STATUS} = 'processing') as chunks_done, coalesce(list(e.event_id order by e.ts desc, e.event_id desc) filter (where event_type = 'purchase'), [])[:20] as outputs
    from (select distinct * from events) e join {_LATEST} l on l.key = e.user_id group by user_id, l.status""")
def file_states_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files' states from events that arrive in two parts, a tenth of the first again with the second; the stream is begun
    anew between them and goes on from its checkpoint."""
    events = _events(spark, sf_dir).withColumn("output", F.col("status") == "completed")
    root = streams.shared_folder(spark)
    early = F.col("event_id") % 3 > 0
    for part in (events.where(early), events.where(~early | (F.col("event_id") % 10 == 1))):
        part.write.mode("append").parquet(f"{root}/in")
        stateful.drain(spark, stateful.file_states(spark.readStream.schema(events.schema).parquet(f"{root}/in"), "400 days", kept=20), f"{root}/out", f"{root}/progress")
    return stateful.newest(spark, f"{root}/out").select("key", "status", "chunks_done", "outputs")


@query("""with recursive t as (select conv_id, turn, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as n from conversations),
    m as (select conv_id, turn, n, sha256(text)[:8] as fact, sha256(text) as history from t where n = 1 union all select t.conv_id, t.turn, t.n, sha256(t.text)[:8], sha256(history || t.text) from m join t on t.conv_id = m.conv_id and t.n = m.n + 1) select conv_id, turn, fact, history from m""")
def rolling_memory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a stream in two parts, the first of which comes twice; each is read with the history that those before it left."""
    turns = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("place"), "text")
    root = streams.shared_folder(spark)
    for part in (turns.where("place < 2"), turns):
        part.write.mode("append").parquet(f"{root}/in")
        stateful.drain(spark, stateful.memory(spark.readStream.schema(turns.schema).parquet(f"{root}/in"), lambda text, history: ([workflows.stub(text)[:8]], workflows.stub(history + text))), f"{root}/out", f"{root}/progress", "append")
    return spark.read.parquet(f"{root}/out").select(F.col("key").alias("conv_id"), F.col("place").alias("turn"), F.col("facts")[0].alias("fact"), "history")


@query("""select event_type, event_id, rank, '{"token": "[REDACTED]", "n": ' || event_id || ', "kind": "' || event_type || '"}' as request from (select event_type, event_id, row_number() over (partition by event_type order by ts desc, event_id desc)::int as rank from events) where rank <= 5""")
def recorded_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five calls of each service, their payloads without secrets."""
    payload = F.to_json(F.struct(F.lit("abc").alias("token"), F.col("event_id").alias("n"), F.col("event_type").alias("kind")))
    rows = load(spark, sf_dir, "events").select("event_type", "event_id", "ts", payload.alias("request"))
    return state.recorded(rows, "event_type", [F.desc("ts"), F.desc("event_id")], ["request"]).select("event_type", "event_id", "rank", "request")


@query("""select conv_id, turn, claim, row_number() over (partition by conv_id order by turn desc)::int as rank from (select conv_id, turn, coalesce(text, '')[1:40] as claim from conversations where role <> 'system') qualify rank <= 20""")
def kept_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty facts of each conversation that are sure enough."""
    confidence = F.when(F.col("role") == "system", "low").otherwise("high")
    rows = load(spark, sf_dir, "conversations").where("role is not null").select("conv_id", "turn", confidence.alias("confidence"), F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("claim"))
    return state.kept_facts(rows, "conv_id", [F.desc("turn")]).select("conv_id", "turn", "claim", "rank")
