"""Queries of semantic chunks and structural overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators import overlap, semantic
from scriptorium.plans import sql
from scriptorium.plans.chunk_queries import markdown
from scriptorium.plans.registry import query

MOST, LEAST = 120, 30


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir, "# code ")


@query(f"select conv_id, section::int as section, kind, coalesce(heading, '') as heading, md5(text) as digest from ({sql.SECTIONS})")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return semantic.markdown_sections(_docs(spark, sf_dir), "conv_id").select("conv_id", "section", "kind", "heading", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""select conv_id, kind, count(*) as n, md5(string_agg(text, chr(10) order by first)) as digest from (
    select conv_id, case when fence then 'code_fence' else 'table' end as kind, min(line) as first, {sql.stripped('string_agg(content, chr(10) order by line)')} as text
    from (select *, case when fence then f else count(*) filter (where not bar) over (partition by conv_id order by line) end as g from ({sql.BLOCK_LINES})) where fence or bar group by conv_id, fence, g) group by conv_id, kind""")
def atomic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.atomic_blocks(_docs(spark, sf_dir), "conv_id")
    lists = found.groupBy("conv_id", "kind").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("position", "text"))).alias("xs"))
    return lists.select("conv_id", "kind", "n", F.md5(F.array_join(F.transform("xs", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))


@query(f"""{sql.semantic(MOST, LEAST)} select conv_id, chunk::int as chunk, {sql.tokens('text')} as tokens, boundary, heading, contains(text, '```') as has_code, has_table, md5(text) as digest from chunks""")
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.semantic_chunks(_docs(spark, sf_dir), MOST, LEAST, "conv_id")
    return found.select("conv_id", "chunk", "tokens", "boundary", "heading", "has_code", "has_table", F.md5(F.col("text").cast("binary")).alias("digest"))


_NAME = "'chunk_' || lpad((chunk + 1)::varchar, 3, '0')"


@query(f"""{sql.semantic(MOST, LEAST)} select conv_id, {_NAME} as chunk_id, 'chunks/' || {_NAME} || '.md' as path, case when heading <> '' then heading else trim(regexp_extract(text, '(?m)^[ \\t]*#+([^\\n]*)', 1)) end as section, length(text)::int as char_count,
    {sql.tokens('text')} as token_estimate, array_to_string(list_filter([case when contains(text, '```') then 'code' end, case when has_table then 'table' end], lambda x: x is not null), ',') as tags,
    lag({_NAME}) over w as previous_id, lead({_NAME}) over w as next_id from chunks window w as (partition by conv_id order by chunk)""")
def raw_extract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = semantic.raw_extract_chunks(_docs(spark, sf_dir), MOST, LEAST, "conv_id")
    return found.select("conv_id", "chunk_id", "path", "section", "char_count", "token_estimate", F.array_join("semantic_tags", ",").alias("tags"), "previous_id", "next_id")


@query()
def semantic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each chunk lies in its text; a test holds it against a search in Python."""
    docs = _docs(spark, sf_dir)
    return semantic.located(semantic.semantic_chunks(docs, MOST, LEAST, "conv_id"), docs, "conv_id").select("conv_id", "chunk", "label", "prefix", "char_start", "char_end")


@query()
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections merged, cut and joined under a budget; a test holds them against Python."""
    found = overlap.markdown_chunks(_docs(spark, sf_dir), MOST, LEAST, "conv_id")
    return found.select("conv_id", "section", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query()
def structural_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the tail of the one before; a test holds them against Python."""
    found = overlap.overlapped_chunks(_docs(spark, sf_dir), MOST, 100, LEAST, "conv_id")
    return found.select("conv_id", "section", "title", "overlap", F.md5(F.col("enriched").cast("binary")).alias("digest"))


@query()
def deduped_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic chunks that aren't like an earlier one of their conversation, with their places; a test holds them against a loop."""
    found = semantic.deduped_spans(_docs(spark, sf_dir), MOST, LEAST, "conv_id")
    return found.select("conv_id", "chunk", "label", "prefix", "char_start", "char_end", F.md5(F.col("text").cast("binary")).alias("digest"))
