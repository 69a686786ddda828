"""Queries of canon tiers, ingest decisions, copies, the delta with a remote store, batches and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions.budgets import percent
from scriptorium.functions.text import normalised
from scriptorium.operators import ingestion, intake, reports, state
from scriptorium.operators.dedup import saved
from scriptorium.operators.stored import StoredSignatures
from scriptorium.plans.registry import query
from scriptorium.plans.state_queries import _LATEST, _latest
from scriptorium.sources.tables import load

TIERS = [(1, "/corpus/src1"), (2, "/corpus/src2"), (3, "/corpus")]
ROOTS = ["/corpus/src1", "/corpus/src2", "/corpus/src3", "/corpus/src4"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as Markdown files: every third below a folder SOT, every fifth with a front matter that marks it."""
    path = F.concat(F.lit("/corpus/"), "source", F.when(F.col("doc_id") % 3 == 0, "/SOT/").otherwise("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    text = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("---\ncategory: SOT\n---\n"), "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", path.alias("path"), text.alias("text"))


_CANON = """select doc_id, case source when 'src1' then 1 when 'src2' then 2 else 3 end::int as tier, '/corpus/' || source || case when doc_id % 3 = 0 then '/SOT/' else '/' end || doc_id || '.md' as path,
    case when doc_id % 5 = 0 then '---' || chr(10) || 'category: SOT' || chr(10) || '---' || chr(10) || text else text end as text from documents where source in ('src1', 'src2', 'src3', 'src4') and (doc_id % 3 = 0 or doc_id % 5 = 0 or source = 'src4')"""


@query(f"select doc_id, tier, path from ({_CANON})")
def canon_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical files of four roots, of which one counts whole."""
    return ingestion.canon(_files(spark, sf_dir), ROOTS, TIERS, ["src4"]).select("doc_id", "tier", "path").orderBy("tier", F.lower("path"))


@query(f"select path, md5('### SOT Tier 1: ' || path || chr(10) || chr(10) || text) as digest from ({_CANON}) where tier = 1 and text is not null")
def canon_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of the first tier alone."""
    found = ingestion.canon(_files(spark, sf_dir), [r for _, r in ingestion.canon_folders(TIERS, True)], TIERS, [])
    return ingestion.canon_parts(found, "path").select("path", F.md5(F.col("part").cast("binary")).alias("digest"))


_NAMED = "(select doc_id, lpad(doc_id::varchar, 9, '0') as name, md5(text) as md5, lang, n_chars, text from documents)"


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.md5(F.col("text").cast("binary")).alias("md5"), "lang", "n_chars", "text")


@query(f"""with f as {_NAMED}, m as (select md5, min(name) as known from f where doc_id % 11 = 0 group by md5), o as (select md5, min(name) as first from f group by md5),
    s as (select name, min(name) over (partition by lang, n_chars // 40) as of from f), d as (select distinct lpad(doc_id::varchar, 9, '0') as name from labels where quality = 1)
    select name, f.md5, case when coalesce(known, first) <> name then 'skipped' when of <> name then 'duplicate' when d.name is not null then 'completed' else 'pending' end as status,
        case when coalesce(known, first) <> name then coalesce(known, first) when of <> name then of end as duplicate_of
    from f left join m on m.md5 = f.md5 left join o on o.md5 = f.md5 join s using (name) left join d using (name)""")
def ingest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; what is like an earlier one is given, by language and size."""
    files = _named(spark, sf_dir)
    first = F.min("name").over(Window.partitionBy("lang", F.floor(F.col("n_chars") / 40)))
    similar = files.withColumn("duplicate_of", first).where("duplicate_of <> name").select("name", "duplicate_of")
    done = load(spark, sf_dir, "labels").where("quality = 1").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"))
    return ingestion.decisions(files.select("name", "md5"), files.where("doc_id % 11 = 0").select("name", "md5"), similar, done)


@query(f"""with recursive f as {_NAMED}, n as (select row_number() over (order by name, md5) as ord, name, md5 from f where doc_id % 3 = 0),
    s as (select 0::bigint as k, (select list({{'place': doc_id, 'name': name, 'md5': md5, 'status': 'pending'}} order by doc_id) from f where doc_id % 2 = 0) as es, (select max(doc_id) from f where doc_id % 2 = 0) as base
      union all select k + 1, case when spot is null then list_append(es, {{'place': base + k + 1, 'name': m, 'md5': d, 'status': 'completed'}}) else list_transform(es, lambda x, i: case when i = spot then {{'place': x.place, 'name': m, 'md5': d, 'status': 'completed'}} else x end) end, base
        from (select s.k, s.es, s.base, n.name as m, n.md5 as d, list_position(list_transform(s.es, lambda x: x.name = n.name or x.md5 = n.md5), true) as spot from s join n on n.ord = s.k + 1))
    select e.place, e.name, e.md5, e.status from (select unnest(es) as e from s where k = (select count(*) from n))""")
def manifest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are done take the place of the first entry of their name or digest."""
    files = _named(spark, sf_dir)
    entries = files.where("doc_id % 2 = 0").select(F.col("doc_id").alias("place"), "name", "md5", F.lit("pending").alias("status"))
    return ingestion.registered_entries(entries, files.where("doc_id % 3 = 0").select("name", "md5", F.lit("completed").alias("status")))


@query("""select source || '/' || doc_id as key, case when doc_id % 3 = 0 and (doc_id % 4 > 0 or doc_id % 5 = 0) then 'skip' else 'copy' end as action from documents""")
def copy_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the files is there, a quarter of them changed, a fifth noted in the manifest."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"), F.col("doc_id").cast("string").alias("rel"), F.octet_length("text").alias("size"), F.md5(F.col("text").cast("binary")).alias("md5"))
    keyed = docs.withColumn("key", F.concat_ws("/", "label", "rel"))
    there = keyed.where("doc_id % 3 = 0").select("key", "size", F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(F.col("md5")).alias("md5"))
    return ingestion.copy_plan(docs.drop("doc_id"), there, keyed.where("doc_id % 5 = 0").select("key", "md5")).select("key", "action")


@query("""with f as (select doc_id, source || '/doc ' || doc_id || case when doc_id % 10 = 9 then '.pdf' else '.md' end as rel, md5(text) as md5 from documents),
    k as (select 'custom/' || replace(rel, ' ', '-') || '.json' as key from f where doc_id % 4 = 1 union all select rel from f where doc_id % 4 = 2),
    t as (select f.rel from f join k on contains(key, rel) or contains(key, string_split(rel, '/')[-1])
        or contains(replace(replace(lower(key), ' ', '_'), '-', '_'), replace(regexp_replace(string_split(rel, '/')[-1], '\\.[^.]*$', ''), ' ', '_')))
    select rel, md5, case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'cached' when rel in (select rel from t) then 'remote' else 'pending' end as action,
        case when doc_id % 3 = 0 and doc_id % 2 = 0 then 'at' when rel in (select rel from t) and doc_id % 3 = 0 then 'at' else 'manual-ui' end as location from f where doc_id % 10 <> 9""")
def remote_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; a third is in the cache, half of it with another digest; a store's keys name some."""
    kind = F.when(F.col("doc_id") % 10 == 9, ".pdf").otherwise(".md")
    files = load(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/doc "), F.col("doc_id").cast("string"), kind).alias("rel"), F.md5(F.col("text").cast("binary")).alias("md5"))
    cache = files.where("doc_id % 3 = 0").select("rel", ingestion.uploaded_entry(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.lit("at").alias("location"), "md5"))).otherwise("at")).alias("e")).select("rel", "e.*")
    keys = files.where("doc_id % 4 = 1").select(F.concat(F.lit("custom/"), F.replace("rel", F.lit(" "), F.lit("-")), F.lit(".json")).alias("key")).unionByName(files.where("doc_id % 4 = 2").select(F.col("rel").alias("key")))
    return ingestion.remote_delta(files.select("rel", "md5"), cache, keys)


@query(f"""with q as (select key, status, row_number() over (order by case when key % 10 = 0 then 0 else 1 end, ts, key) as n from {_LATEST} where status in ('pending', 'processing', 'failed'))
    select key, case when n <= 50 and key % 4 > 0 then 'completed' when n <= 50 then 'failed' else l.status end as status, case when n <= 50 and key % 4 = 0 then 'file not found' end as error from {_LATEST} l left join q using (key)""")
def gap_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty of the queue; a quarter of the files isn't there."""
    now = _latest(spark, sf_dir).select("key", "ts", "status")
    return ingestion.batch(now, now.where("key % 4 > 0").select("key"), 50, ["ts", "key"], F.col("key") % 10 == 0).select("key", "status", "error")


@query("""select p_partkey, slug || case when n > 1 then '-' || n else '' end as slug from (select p_partkey, lower(replace(p_type, ' ', '-')) as slug, row_number() over (partition by p_type order by p_partkey) as n from part)""")
def project_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "part").select("p_partkey", F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))).alias("slug"))
    return ingestion.unique_slugs(rows, ["p_partkey"])


@query("""select file, rank, session, file not in (select 'p' || p_partkey from part) as orphan from (select file, session, row_number() over (partition by file order by d desc, session desc)::int as rank
    from (select distinct 'p' || l_partkey % 250 as file, l_orderkey as session, o_orderdate as d from lineitem join orders on o_orderkey = l_orderkey)) where rank <= 3""")
def dev_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions that touch parts; parts beyond the table are orphans."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat(F.lit("p"), (F.col("l_partkey") % 250).cast("string"))).alias("files"))
    sessions = lines.join(load(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("session"), F.col("o_orderdate").alias("date"), "files")
    return ingestion.history(sessions, load(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file")))


@query("select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority, o_orderdate, o_orderkey)::int as place from orders qualify place <= 100")
def job_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred jobs by priority, then by their coming."""
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100)
    return rows.select("o_orderkey", "o_orderpriority", F.row_number().over(Window.orderBy("o_orderpriority", "o_orderdate", "o_orderkey")).alias("place"))


@query("""select l_orderkey, l_linenumber, least(99, round_even((n - 1 + l_linenumber / 7.0::double) / n * 100, 0)::int) as percent, l_linenumber || '/7' as phase from lineitem join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) using (l_orderkey)""")
def phase_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress inside the last file of a job, seven phases to a file."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    rows = lines.join(lines.groupBy("l_orderkey").agg(F.count("*").alias("n")), "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", percent(F.col("n") - 1 + F.col("l_linenumber") / 7, F.col("n"), 99).alias("percent"), F.concat(F.col("l_linenumber").cast("string"), F.lit("/7")).alias("phase"))


@query("""select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 20""")
def written_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty outputs of each job; the log of all outputs is bounded in the same way."""
    return state.last_of_each(load(spark, sf_dir, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("select event_id from events order by ts desc, event_id desc limit 500")
def output_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.newest(load(spark, sf_dir, "events"), [F.desc("ts"), F.desc("event_id")], 500).select("event_id")


@query("""select doc_id, lang as area, length(text) as size, coalesce(case when quality = 1 then 'SOT' end, 'Raw') as role from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) using (doc_id) where lang in ('en', 'fr')""")
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of some areas with their roles, Raw where none is noted."""
    roles = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", F.when(F.col("quality") == 1, "SOT").alias("role"))
    files = load(spark, sf_dir, "documents").where(F.col("lang").isin("en", "fr")).select("doc_id", F.col("lang").alias("area"), F.length("text").cast("long").alias("size"))
    return files.join(roles, "doc_id", "left").withColumn("role", F.coalesce("role", F.lit("Raw")))


@query()
def ingest_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files that an ingest decides on in order of name, each against those before it and a manifest of every
    eleventh, by digest and by likeness of their texts; a test holds it against a loop."""
    files = _named(spark, sf_dir)
    done = load(spark, sf_dir, "labels").where("quality = 1").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"))
    entries = files.where("doc_id % 11 = 0").select(F.col("doc_id").alias("place"), "name", "md5")
    return intake.ingest_pass(files.select("name", "md5", "text"), entries, done).select("name", "status", "duplicate_of", "similarity")


@query()
def stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in two parts at a stored index of signatures: what each is like among those that stayed before it."""
    files = _named(spark, sf_dir).select("doc_id", "name", "md5", normalised(F.col("text")).alias("norm"))
    index, found = StoredSignatures(spark, f"signed_{uuid.uuid4().hex}", buckets=8), None
    for part in ("doc_id % 3 > 0", "doc_id % 3 = 0"):
        one = index.arrive(files.where(part).select("name", "md5", "norm"))
        found = one if found is None else found.unionByName(one)
    found = saved(found)
    index.drop()
    return found
