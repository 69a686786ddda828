"""The document map as tables: entries with defaults, checked inserts, patches, removals, flags and links.

Each kind of entry is a table of rows with a key; what a document's map would hold as nested lists are rows here, so that
changes are joins and maps of any number of documents change together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.dedup import upsert

#: Flags of a chunk, and buckets of the rolling memory.
KNOWLEDGE = ["facts_extracted", "vision_complete", "conflict_checked", "rolling_context_merged"]
BUCKETS = ["entities", "facts", "constraints", "decisions", "open_questions", "vision_insights", "temporal_markers"]
_FLAGS = "map_from_arrays(array({}), array({}))".format(", ".join(f"'{k}'" for k in KNOWLEDGE), ", ".join("false" for _ in KNOWLEDGE))
#: Columns of each kind with their types and defaults.
COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "chunks": {
        "path": ("string", "concat('chunks/', id, '.md')"), "enriched_path": ("string", "concat('enriched/', id, '.enriched.md')"), "section": ("string", "''"), "pages": ("array<int>", "array()"),
        "char_count": ("int", "0"), "token_estimate": ("int", "0"), "previous_chunk": ("string", "null"), "next_chunk": ("string", "null"), "rolling_context_ref": ("string", "null"),
        "assets": ("array<string>", "array()"), "semantic_tags": ("array<string>", "array()"), "entities": ("array<string>", "array()"), "knowledge_state": ("map<string,boolean>", _FLAGS),
    },
    "images": {"path": ("string", "''"), "page": ("int", "null"), "hash": ("string", "''"), "vision_processed": ("boolean", "false"), "linked_chunks": ("array<string>", "array()")},
    "tables": {"path": ("string", "''"), "page": ("int", "null"), "linked_chunks": ("array<string>", "array()"), "extraction_confidence": ("double", "null")},
    "rules": {"type": ("string", "''"), "target": ("string", "''"), "action": ("string", "''")},
    "conflicts": {"status": ("string", "'pending_human_review'"), "chunks": ("array<string>", "array()"), "reason": ("string", "''")},
}


def filled(rows: DataFrame, kind: str) -> DataFrame:
    """Rows (id, and whatever columns there are) with all columns of a kind; missing ones, nulls and empty paths get their defaults."""
    def of(name: str, kind_of: str, default: str) -> Column:
        value = F.expr(default).cast(kind_of)
        if name not in rows.columns:
            return value.alias(name)
        own = F.col(name).cast(kind_of)
        return F.coalesce(F.nullif(own, F.lit("")) if kind_of == "string" else own, value).alias(name)

    extra = [c for c in rows.columns if c not in COLUMNS[kind]]
    return rows.select(*extra, *[of(c, t, d) for c, (t, d) in COLUMNS[kind].items()])


def insert_verdicts(table: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """New rows with `verdict`: missing_id, duplicate (in the table or earlier among the new ones), or inserted."""
    own = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    marked = new.withColumn("_key", own).withColumn("_first", F.row_number().over(Window.partitionBy("_key").orderBy(order)))
    there = table.select(F.trim(F.col(key).cast("string")).alias("_key")).distinct().withColumn("_there", F.lit(True))
    verdict = F.when(F.col("_key").isNull(), "missing_id").when(F.col("_there") | (F.col("_first") > 1), "duplicate").otherwise("inserted")
    return marked.join(there, "_key", "left").withColumn("verdict", verdict).drop("_key", "_first", "_there")


def inserted(table: DataFrame, new: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The table with those new rows that insert_verdicts() lets in."""
    let_in = insert_verdicts(table, new, order, key).where("verdict = 'inserted'")
    return table.unionByName(let_in.select(*[c for c in let_in.columns if c in table.columns]), allowMissingColumns=True)


def replaced(table: DataFrame, new: DataFrame, group: str, order: str, kind: str = "chunks", key: str = "id") -> DataFrame:
    """The table with the rows of whole groups replaced by new ones, filled up and linked with their neighbours.

    Rows without an id fail the job: a chunk table that has lost ids must not be written.
    """
    checked = new.withColumn(key, F.when(F.coalesce(F.trim(F.col(key)), F.lit("")) == "", F.raise_error(F.lit("each chunk needs an id"))).otherwise(F.col(key)))
    w = Window.partitionBy(group).orderBy(order)
    linked = filled(checked, kind).withColumns({"previous_chunk": F.lag(key).over(w), "next_chunk": F.lead(key).over(w)})
    return table.join(new.select(group).distinct(), group, "left_anti").unionByName(linked, allowMissingColumns=True)


def patched(table: DataFrame, patch: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with the patch's cells by key, and the keys of the patch that the table lacks."""
    known = patch.join(table.select(key), key, "left_semi")
    return upsert(table, known, key), patch.select(key).join(table.select(key), key, "left_anti")


def removed(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The table without some keys; links of other rows stay as they are."""
    return table.join(keys.select(key).distinct(), key, "left_anti")


def flagged(old: Column, new: Column) -> Column:
    """Flags with new ones in place of old ones of the same name."""
    empty = F.create_map().cast("map<string,boolean>")
    return F.map_zip_with(F.coalesce(old, empty), F.coalesce(new, empty), lambda k, a, b: F.coalesce(b, a))


def image_links(images: DataFrame, chunks: DataFrame, group: str, order: str) -> DataFrame:
    """Images (group, id, linked_chunks) with the chunks (group, id, assets) that name them added, each once, in order."""
    named = chunks.select(group, F.col(order).alias("_o"), F.col("id").alias("_chunk"), F.explode("assets").alias("id"))
    lists = named.groupBy(group, "id").agg(F.array_sort(F.collect_list(F.struct("_o", "_chunk"))).alias("_xs"))
    both = images.join(lists, [group, "id"], "left")
    none = F.array().cast("array<string>")
    more = F.coalesce(F.transform("_xs", lambda x: x["_chunk"]), none)
    return both.withColumn("linked_chunks", F.array_distinct(F.concat(F.coalesce("linked_chunks", none), more))).drop("_xs")


def vision_prompts(images: DataFrame, chunks: DataFrame, group: str) -> DataFrame:
    """group, id and context of each image that isn't described yet: the texts of its linked chunks, in the links' order."""
    waiting = images.where(~F.coalesce("vision_processed", F.lit(False)))
    links = waiting.select(group, "id", F.posexplode_outer("linked_chunks").alias("_o", "_chunk"))
    texts = links.join(chunks.select(group, F.col("id").alias("_chunk"), "text"), [group, "_chunk"], "left")
    lists = texts.groupBy(group, "id").agg(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_o", "text")))).alias("_xs"))
    return lists.select(group, "id", F.array_join(F.transform("_xs", lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("context"))


def merged_memory(old: DataFrame, patch: DataFrame, group: str) -> DataFrame:
    """(group, bucket, items): items of the patch added to the known buckets, each once; unknown buckets are left out."""
    none = F.array().cast("array<string>")
    known = patch.where(F.col("bucket").isin(*BUCKETS)).select(group, "bucket", F.col("items").alias("_new"))
    both = old.join(known, [group, "bucket"], "full")
    return both.select(group, "bucket", F.array_union(F.coalesce("items", none), F.coalesce("_new", none)).alias("items"))


_KNOWN = ["document_id", "id", "created_at", "source_file", "document_type", "ingestion_timestamp", "pipeline_version", "map_schema_version"]


def map_header(raw: Column) -> Column:
    """The head of a map from its JSON, old forms (`id`, `created_at`) brought to the present one; other members go to `extras`."""
    cells = F.from_json(raw, "map<string,string>")
    of = lambda name: F.nullif(F.try_element_at(cells, F.lit(name)), F.lit(""))
    return F.struct(
        F.coalesce(of("document_id"), of("id"), F.lit("")).alias("document_id"), F.coalesce(of("source_file"), F.lit("")).alias("source_file"), F.coalesce(of("document_type"), F.lit("unknown")).alias("document_type"),
        F.coalesce(of("ingestion_timestamp"), of("created_at")).alias("ingestion_timestamp"), F.coalesce(of("pipeline_version"), F.lit("2.0")).alias("pipeline_version"),
        F.coalesce(of("map_schema_version").try_cast("int"), F.lit(1)).alias("map_schema_version"), F.map_filter(cells, lambda k, v: ~k.isin(*_KNOWN)).alias("extras"),
    )
