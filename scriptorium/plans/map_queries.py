"""Queries of the document map: defaults, checked inserts, patches, removals, flags, links and contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import docmap
from scriptorium.plans.registry import query
from scriptorium.sources.tables import load


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunk entries, some of whose cells are missing."""
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"), "doc_id", "lang",
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("section"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).cast("int").alias("char_count"),
    )


@query("""select 'c' || doc_id as id, 'chunks/c' || doc_id || '.md' as path, 'enriched/c' || doc_id || '.enriched.md' as enriched_path, case when doc_id % 2 = 0 then coalesce(source, '') else '' end as section,
    case when doc_id % 3 = 0 then n_chars else 0 end::int as char_count, 0::bigint as n_links, 4::bigint as n_flags from documents""")
def map_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docmap.filled(_entries(spark, sf_dir), "chunks")
    links = F.size("pages") + F.size("assets") + F.size("semantic_tags") + F.size("entities")
    flags = F.size(F.map_filter("knowledge_state", lambda k, v: ~v))
    return found.select("id", "path", "enriched_path", "section", "char_count", links.cast("long").alias("n_links"), flags.cast("long").alias("n_flags"))


@query("""select event_id, case when user_id % 7 = 0 then 'missing_id' when user_id in (select doc_id from documents where doc_id % 3 = 0) or row_number() over (partition by user_id order by event_id) > 1 then 'duplicate' else 'inserted' end as verdict from events""")
def map_insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as new entries: blank ids, ids of the table, and ids that come twice aren't let in."""
    table = load(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"))
    new = load(spark, sf_dir, "events").select(F.when(F.col("user_id") % 7 == 0, " ").otherwise(F.col("user_id").cast("string")).alias("id"), "event_id")
    return docmap.insert_verdicts(table, new, "event_id").select("event_id", "verdict")


@query("""with n as (select item_id, 'k' || item_id % 30 as id, row_number() over (partition by item_id % 30 order by item_id) as place, length(text)::int as page, text[:20] as t from benchmark)
    select 'images' as kind, id, page::varchar as a, 'false' as b from n where place = 1 union all select 'tables', id, null, (item_id / 4.0)::double::varchar from n where place = 1
    union all select 'rules', id, t, '' from n where place = 1 union all select 'conflicts', id, t, 'pending_human_review' from n where place = 1""")
def map_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images, tables, rules and conflicts: of items with one id the first is registered, with its defaults."""
    new = load(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), (F.col("item_id") % 30).cast("string")).alias("id"), "item_id", F.length("text").alias("page"), F.substring("text", 1, 20).alias("t"))
    out = None
    shapes = {"images": ("page", "page", "vision_processed"), "tables": ("extraction_confidence", None, "extraction_confidence"), "rules": ("type", "type", "action"), "conflicts": ("reason", "reason", "status")}
    for kind, (cell, a, b) in shapes.items():
        rows = new.select("id", "item_id", (F.col("item_id") / 4.0 if kind == "tables" else F.col("page") if kind == "images" else F.col("t")).alias(cell))
        empty = docmap.filled(spark.createDataFrame([], "id string, item_id long"), kind)
        found = docmap.inserted(empty, docmap.filled(rows, kind), "item_id")
        one = found.select(F.lit(kind).alias("kind"), "id", (F.col(a).cast("string") if a else F.lit(None).cast("string")).alias("a"), F.col(b).cast("string").alias("b"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""select doc_id, coalesce(case when toxic = 1 then 'toxic' end, case when doc_id % 2 = 0 then source end) as section, case when doc_id % 3 = 0 then n_chars end::int as char_count, null::boolean as missing from documents left join (select doc_id, max(toxic) as toxic from labels where doc_id % 5 > 0 group by doc_id) using (doc_id)
    union all select distinct -1 - doc_id, null, null, true from labels where doc_id % 5 > 0""")
def map_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches by key, and the keys of patches that have no entry."""
    table = _entries(spark, sf_dir).select("doc_id", "section", "char_count")
    marks = load(spark, sf_dir, "labels").where("doc_id % 5 > 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).select("doc_id", F.when(F.col("toxic") == 1, "toxic").alias("section"))
    found, missing = docmap.patched(table, marks.unionByName(marks.select((-1 - F.col("doc_id")).alias("doc_id"), "section")), "doc_id")
    return found.withColumn("missing", F.lit(None).cast("boolean")).unionByName(missing.withColumn("missing", F.lit(True)), allowMissingColumns=True)


@query("""select doc_id, lang from documents where doc_id not in (select doc_id from labels where toxic = 1 and doc_id is not null)""")
def map_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docmap.removed(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id")


@query("""select doc_id, coalesce(quality = 1, false) as facts_extracted, coalesce(toxic = 1, doc_id % 2 = 0) as vision_complete, doc_id % 2 = 0 as conflict_checked from documents left join (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id) using (doc_id)""")
def map_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    old = F.create_map(F.lit("facts_extracted"), F.lit(False), F.lit("vision_complete"), even, F.lit("conflict_checked"), even)
    marks = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = load(spark, sf_dir, "documents").select("doc_id", old.alias("old")).join(marks, "doc_id", "left")
    new = F.when(F.col("toxic").isNotNull(), F.create_map(F.lit("facts_extracted"), F.col("quality") == 1, F.lit("vision_complete"), F.col("toxic") == 1))
    state = docmap.flagged(F.col("old"), new)
    return rows.select("doc_id", *[state[k].alias(k) for k in ("facts_extracted", "vision_complete", "conflict_checked")])


def _images(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Images 0 and 1 of each conversation, linked with chunk t0 already, and its turns as chunks that name image turn % 3."""
    rows = load(spark, sf_dir, "conversations")
    chunks = rows.select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"), F.array(F.concat(F.lit("img_"), (F.col("turn") % 3).cast("string"))).alias("assets"), "text")
    images = rows.select("conv_id").distinct().select("conv_id", F.explode(F.array(F.lit("img_0"), F.lit("img_1"))).alias("id")).withColumns({"linked_chunks": F.array(F.lit("t0")), "vision_processed": F.lit(False)})
    return images, chunks


_LINKS = """select i.conv_id, i.id, list_concat(['t0'], coalesce(list('t' || turn order by turn) filter (where turn > 0 and turn % 3 = right(i.id, 1)::int), [])) as links
    from (select distinct conv_id, unnest(['img_0', 'img_1']) as id from conversations) i join conversations using (conv_id) group by i.conv_id, i.id"""


@query(f"select conv_id, id, array_to_string(links, ',') as links from ({_LINKS})")
def map_image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, chunks = _images(spark, sf_dir)
    return docmap.image_links(images, chunks, "conv_id", "turn").select("conv_id", "id", F.array_join("linked_chunks", ",").alias("links"))


@query(f"""select l.conv_id, l.id, md5(coalesce(string_agg(text || chr(10), '' order by turn) filter (where text is not null), '')) as digest
    from (select conv_id, id, unnest(links) as link from ({_LINKS})) l left join conversations c on c.conv_id = l.conv_id and 't' || turn = link group by l.conv_id, l.id""")
def vision_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    images, chunks = _images(spark, sf_dir)
    found = docmap.vision_prompts(docmap.image_links(images, chunks, "conv_id", "turn"), chunks, "conv_id")
    return found.select("conv_id", "id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("""select user_id, bucket, array_to_string(list_sort(list_distinct(list(event_type))), ',') as items from (select user_id, event_type, case event_id % 3 when 0 then 'facts' when 1 then 'entities' end as bucket from events) where bucket is not null group by user_id, bucket""")
def map_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the items are there, half come with a patch; a third of the buckets is unknown."""
    bucket = F.element_at(F.array(F.lit("facts"), F.lit("entities"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = load(spark, sf_dir, "events").select("user_id", bucket.alias("bucket"), "event_type", "event_id")
    part = lambda k: rows.where(f"event_id % 2 = {k}").groupBy("user_id", "bucket").agg(F.collect_set("event_type").alias("items"))
    found = docmap.merged_memory(part(0).where("bucket <> 'other'"), part(1), "user_id")
    return found.select("user_id", "bucket", F.array_join(F.array_sort("items"), ",").alias("items"))


@query("""select doc_id, doc_id::varchar as document_id, 'unknown' as document_type, case when doc_id % 2 = 0 then 'then' else 'now' end as ingestion_timestamp, '2.0' as pipeline_version, case when doc_id % 3 = 0 then 3 else 1 end::int as map_schema_version, lang as owner from documents""")
def map_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of maps of the old and of the present form."""
    new = F.to_json(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit("now").alias("ingestion_timestamp"), F.col("lang").alias("owner")))
    old = F.to_json(F.struct(F.col("doc_id").alias("id"), F.lit("then").alias("created_at"), F.col("lang").alias("owner")))
    raw = F.when(F.col("doc_id") % 2 == 0, old).otherwise(new)
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"map_schema_version": 3, '), F.substring(raw, 2, 1 << 30))).otherwise(raw)
    found = load(spark, sf_dir, "documents").select("doc_id", docmap.map_header(raw).alias("x"))
    return found.select("doc_id", "x.document_id", "x.document_type", "x.ingestion_timestamp", "x.pipeline_version", "x.map_schema_version", F.col("x.extras")["owner"].alias("owner"))


@query("""select conv_id, id, previous_chunk, next_chunk from (select conv_id, 't' || turn as id, lag('t' || turn) over w as previous_chunk, lead('t' || turn) over w as next_chunk from conversations where conv_id % 2 = 0 window w as (partition by conv_id order by turn))
    union all select conv_id, 'old', null, null from conversations where conv_id % 2 = 1 group by conv_id""")
def map_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunk tables of even conversations written anew; the others stay."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("id"))
    there = rows.select("conv_id").distinct().select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("old").alias("id"))
    found = docmap.replaced(docmap.filled(there, "chunks"), rows.where("conv_id % 2 = 0"), "conv_id", "turn")
    return found.select("conv_id", "id", "previous_chunk", "next_chunk")
