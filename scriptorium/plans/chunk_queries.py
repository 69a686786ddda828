"""Queries of chunking and the document map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.functions.text import collapsed
from scriptorium.operators import chunking, reports, retrieval
from scriptorium.plans import sql, workflows
from scriptorium.plans.registry import query
from scriptorium.sources.tables import load

_SENTENCES = f"""select doc_id, lang, list_filter(list_transform(string_split(regexp_replace({sql.collapsed('text')}, '([.!?…])\\s+([A-ZÀ-ÿ0-9"''`(])', '\\1␞\\2', 'g'), '␞'), lambda s: trim(s)), lambda s: s <> '') as units"""


def markdown(spark: SparkSession, sf_dir: str, code: str = "code ") -> DataFrame:
    """conv_id and its turns as Markdown: a heading each, a fence for assistants, a table every third turn."""
    turn = F.col("turn").cast("string")
    body = F.concat(
        F.lit("## Turn "), turn, F.lit(" "), F.coalesce("role", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")),
        F.when(F.col("role") == "assistant", F.concat(F.lit("\n\n```\n" + code), turn, F.lit("\n```"))).otherwise(""),
        F.when(F.col("turn") % 3 == 0, "\n\n| a | b |\n|---|---|\n| 1 | 2 |").otherwise(""),
    )
    parts = load(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "text", body.alias("body")).alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    return parts.select("conv_id", F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.array_join(F.transform("ts", lambda t: t["body"]), "\n\n")).alias("text"))


@query(f"""with recursive s as ({_SENTENCES} from (select * from documents qualify row_number() over (partition by md5({sql.normalised('text')}) order by doc_id) = 1)),
    p as (select doc_id, lang, units, 1 as i, 0 as chunk, units[1] as text, {sql.tokens('units[1]')} as n from s where len(units) > 0
      union all select doc_id, lang, units, i + 1, case when n + {sql.tokens('units[i + 1]')} <= 100 then chunk else chunk + 1 end,
        case when n + {sql.tokens('units[i + 1]')} <= 100 then text || ' ' || units[i + 1] else units[i + 1] end,
        case when n + {sql.tokens('units[i + 1]')} <= 100 then n else 0 end + {sql.tokens('units[i + 1]')} from p where i < len(units))
    select doc_id, lang, chunk, {sql.tokens('text')} as tokens, md5(text) as digest from (select *, row_number() over (partition by doc_id, chunk order by i desc) as last from p) where last = 1""")
def sentence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.sentence_pack(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "lang", "chunk", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"{_SENTENCES.replace('select doc_id, lang, ', 'select doc_id, len(', 1)[: -len(' as units')]})::int as n_sentences from documents")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.size(chunking.sentences(collapsed(F.col("text")))).alias("n_sentences"))


_PARTS = f"select conv_id, unnest(string_split(regexp_replace(text, '\\n## ', '␞## ', 'g'), '␞')) as part, unnest(range(len(string_split(regexp_replace(text, '\\n## ', '␞## ', 'g'), '␞')))) as section from ({sql.VIEW})"


@query(f"""select conv_id, section::int as section, case when section = 0 then 'preamble' else trim(string_split(part, chr(10))[1]) end as title, md5(regexp_replace(part, '^\\s+|\\s+$', '', 'g')) as digest from ({_PARTS})""")
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.sections(markdown(spark, sf_dir), "conv_id")
    return found.select("conv_id", "section", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"""select conv_id, line::int as line, length(regexp_extract(content, '^(#+)', 1))::int as level, trim(regexp_extract(content, '^#+\\s+(.*)$', 1)) as title,
    'Conversation ' || conv_id as h1, case when starts_with(content, '## ') then trim(regexp_extract(content, '^#+\\s+(.*)$', 1)) else '' end as h2
    from (select *, count(*) filter (where starts_with(trim(content), '```')) over (partition by conv_id order by line) % 2 = 1 as fenced from ({sql.LINES.replace(sql.VIEW, sql.FENCED_VIEW)})) where not fenced and regexp_matches(content, '^#{{1,3}}\\s+\\S')""")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_path(markdown(spark, sf_dir, "# code "), "conv_id")


@query(f"""select conv_id, span::int as span, min(start_at)::bigint as start, max(start_at + length(content) + 1)::bigint as stop from (select *, (row_number() over (partition by conv_id order by line) - 1) // 2 as span from ({sql.LINES}) where starts_with(trim(content), '```')) group by conv_id, span having count(*) = 2""")
def fence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.fence_spans(markdown(spark, sf_dir), "conv_id")


@query(f"""select conv_id, min(line)::int as first_line, count(*) as n_lines from (select *, line - row_number() over (partition by conv_id order by line) as run from ({sql.LINES}) where regexp_matches(trim(content), '^\\|.*\\|$')) group by conv_id, run having count(*) >= 2""")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.table_blocks(markdown(spark, sf_dir), "conv_id")


_SECTIONS = f"""select conv_id, row_number() over (partition by conv_id order by section) as n, case when section = 0 then 'preamble' else trim(string_split(part, chr(10))[1]) end as title, regexp_replace(part, '^\\s+|\\s+$', '', 'g') as text from ({_PARTS})"""
_PARAGRAPHS = f"""select conv_id, n, p as text, false as alone from (select conv_id, unnest(ps) as p, unnest(range(1, len(ps) + 1)) as n from (select conv_id, list_filter(list_transform(string_split(regexp_replace(text, '\\n\\s*\\n', '␞', 'g'), '␞'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') as ps from ({sql.VIEW})))"""
_UNITS = f"""select conv_id, row_number() over (partition by conv_id order by n, i) as n, case when long then text[i * 240 + 1:i * 240 + 240] else text end as text, long as alone from (select *, {sql.tokens('text')} > 60 as long, unnest(case when {sql.tokens('text')} > 60 then range((length(text) - 1) // 240 + 1) else [0] end) as i from ({_PARAGRAPHS}))"""


@query(f"""with recursive r as materialized ({_UNITS}), f as (select conv_id, n, 0 as chunk, text as t, case when alone then 61 else {sql.tokens('text')} end as size from r where n = 1
      union all select r.conv_id, r.n, case when fits then chunk else chunk + 1 end, case when fits then t || chr(10) || chr(10) || r.text else r.text end, case when fits then size else 0 end + own
        from (select f.*, r.text, r.n as rn, case when r.alone then 61 else {sql.tokens('r.text')} end as own, size + case when r.alone then 61 else {sql.tokens('r.text')} end <= 60 as fits from f join r on r.conv_id = f.conv_id and r.n = f.n + 1) x join r on r.conv_id = x.conv_id and r.n = x.rn)
    select conv_id, chunk::int as chunk, {sql.tokens('arg_max(t, n)')} as tokens, md5(arg_max(t, n)) as digest from f group by conv_id, chunk""")
def paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.paragraph_chunks(markdown(spark, sf_dir), 60, ["conv_id"])
    return found.select("conv_id", "chunk", "tokens", F.md5(F.col("text").cast("binary")).alias("digest"))


_JOINT = sql.tokens("t || chr(10) || chr(10) || r.text")


@query(sql.folded(_SECTIONS, f"({_JOINT} <= 120 and ({sql.tokens('l')} < 40 or {sql.tokens('r.text')} < 40))", "arg_min(title, n)"))
def merge_small_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.merge_small(chunking.sections(markdown(spark, sf_dir), "conv_id"), 40, "conv_id")
    return found.select("conv_id", "section", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(sql.folded(_SECTIONS, f"{_JOINT} <= 120", "(case when count(*) = 1 then arg_min(title, n) else arg_min(title, n) || ' (+' || (count(*) - 1) || ' sez.)' end)[1:80]"))
def coalesce_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunking.coalesce_chunks(chunking.sections(markdown(spark, sf_dir), "conv_id"), 120, "conv_id")
    return found.select("conv_id", "section", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""select conv_id, turn, regexp_replace(coalesce(right(lag(coalesce(text, '')) over (partition by conv_id order by turn), 80), ''), '^\\S*\\s', '') as overlap from conversations""")
def overlap_prev_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.with_overlap(rows, "conv_id", "turn", 80).select("conv_id", "turn", "overlap")


@query("""select conv_id, turn, 'chunk_' || lpad(turn::varchar, 3, '0') as chunk_id, lag('chunk_' || lpad(turn::varchar, 3, '0')) over w as previous_id, lead('chunk_' || lpad(turn::varchar, 3, '0')) over w as next_id
    from conversations window w as (partition by conv_id order by turn)""")
def chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("chunk_%03d", "turn").alias("chunk_id"))
    return chunking.linked(rows, "conv_id", "turn")


@query("""select conv_id, image, list(turn order by turn)::varchar as chunks from (select distinct conv_id, turn, 'img_' || lpad((turn // k)::varchar, 3, '0') as image from conversations, (select unnest([1, 2]) as k)) group by conv_id, image""")
def image_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lambda k: F.concat(F.lit("[IMG_REF:img_"), F.lpad(F.floor(F.col("turn") / k).cast("string"), 3, "0"), F.lit("]"))
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(text.image_refs(F.concat(F.col("role"), ref(1), F.lit(" "), ref(2)))).alias("image"))
    lists = rows.groupBy("conv_id", "image").agg(F.array_sort(F.collect_set("turn")).alias("xs"))
    return lists.select("conv_id", "image", F.concat(F.lit("["), F.array_join("xs", ", "), F.lit("]")).alias("chunks"))


@query("""select conv_id, count(*)::int as n_parts, md5('# Gap analysis — `' || conv_id || '`' || chr(10) || chr(10) || '_Analisi pipeline: **' || count(*) || '** parte/i (' || array_to_string(list('turn ' || turn order by turn)[1:8], ', ')
    || case when count(*) > 8 then '…' else '' end || ')._' || chr(10) || chr(10) || string_agg(chr(10) || '## Chunk: turn ' || turn || chr(10) || chr(10) || trim(coalesce(text, '')) || chr(10), chr(10) order by turn)) as digest from conversations group by conv_id""")
def merged_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("label"), F.coalesce("text", F.lit("")).alias("body"))
    found = reports.merged_parts(rows, "conv_id", "turn", "label", "body")
    return found.select("conv_id", "n_parts", F.md5(F.col("report").cast("binary")).alias("digest"))


@query("""select doc_id, '---' || chr(10) || 'category: SPEC' || chr(10) || 'source_file: ' || source || '/' || doc_id || '.txt' || chr(10) || 'status: gap_identified' || chr(10) || 'title: "Doc ' || doc_id || '"' || chr(10) || '---' || chr(10) as header from documents""")
def report_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("doc_id").cast("string")
    return load(spark, sf_dir, "documents").select("doc_id", reports.front_matter(F.concat("source", F.lit("/"), number, F.lit(".txt")), F.concat(F.lit("Doc "), number)).alias("header"))


@query("""select doc_id, md5('## File' || chr(10) || source || chr(10) || chr(10) || '## Context' || chr(10) || lang || chr(10) || chr(10) || '## Text' || chr(10) || text) as digest from documents""")
def gap_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(reports.prompt(F.col("source"), F.col("lang"), F.col("text")).cast("binary")).alias("digest"))


@query("""with g as (select conv_id, part, sha256(string_agg(coalesce(text, ''), chr(10) order by turn)) as a from (select *, (row_number() over (partition by conv_id order by turn) - 1) // 5 as part from conversations) group by conv_id, part)
    select conv_id, count(*) as n_groups, sha256(string_agg(a, chr(10) order by part)) as answer from g group by conv_id""")
def tree_reduce_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body"))
    return workflows.tree_reduce(rows, "conv_id", "turn", "body").select("conv_id", "n_groups", "answer")


@query()
def context_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))
    taken = parts.select("conv_id", retrieval.context_bundle(F.transform("ts", lambda t: t["text"]), 3000).alias("x"))
    return taken.select("conv_id", F.size("x.texts").alias("n_parts"), "x.total", "x.cut_off")
