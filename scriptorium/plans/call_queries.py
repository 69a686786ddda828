"""Queries of replies, payloads, budgets of calls, model choice, contexts, reports and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import budgets, text
from scriptorium.operators import dedup, layout, reports, retrieval, semantic
from scriptorium.plans import sql, workflows
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import MODELS
from scriptorium.sources.tables import load


def _digest(value):
    return F.md5(value.cast("binary"))


@query("""select event_id, case event_id % 3 when 0 then event_type when 1 then 'broken ' || event_type else event_type end as claim, case when event_id % 3 = 1 then 'low' else 'high' end as confidence, event_id % 3 = 1 as parse_error,
    case when event_id % 3 = 1 then event_id end::int as chunk_index, case when event_id % 3 = 1 then 0 else 1 end::int as n_entities from events""")
def parsed_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as plain JSON, as JSON in a fence, and as a text that isn't JSON."""
    good = F.to_json(F.struct(F.array(F.struct(F.col("event_type").alias("claim"), F.lit("high").alias("confidence"), F.lit("1").alias("section"))).alias("facts"), F.array(F.lit("x")).alias("entities")))
    raw = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.concat(F.lit("broken "), "event_type")).otherwise(F.concat(F.lit("```json\n"), good, F.lit("\n```")))
    found = load(spark, sf_dir, "events").select("event_id", text.parsed_reply(raw, F.col("event_id").cast("int")).alias("x"))
    return found.select("event_id", F.col("x.facts")[0]["claim"].alias("claim"), F.col("x.facts")[0]["confidence"].alias("confidence"), "x.parse_error", "x.chunk_index", F.coalesce(F.size("x.entities"), F.lit(0)).alias("n_entities"))


@query(f"""select conv_id, turn, case when role = 'assistant' and length(c) > 30 then md5(c) end as digest from (select *, {sql.stripped("string_split(coalesce(text, ''), '##')[1]")} as c from conversations)""")
def condensed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysis = F.concat(F.lit("## ANALISI\nx\n\n"), F.when(F.col("role") == "assistant", "## CONDENSATO\n").otherwise("## ALTRO\n"), F.coalesce("text", F.lit("")), F.lit("\n\n## END\n"))
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", _digest(text.condensed_part(analysis)).alias("digest"))


@query("""select event_id, '[REDACTED]' as secret, case when event_id % 2 = 0 then '[REDACTED]' else 'Bear ' || event_type end as note, event_type as plain, '[REDACTED]' as deep from events""")
def redacted_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with a secret name, a bearer value in every other row, and a key deep inside a list."""
    note = F.concat(F.when(F.col("event_id") % 2 == 0, "Bearer ").otherwise("Bear "), "event_type")
    raw = F.to_json(F.struct(F.col("event_type").alias("api_key"), note.alias("note"), F.array(F.struct(F.col("event_type").alias("plain"), F.struct(F.lit(5).alias("My-Secret-Id")).alias("in"))).alias("list")))
    found = load(spark, sf_dir, "events").select("event_id", text.redacted_json(raw).alias("x"))
    of = lambda path, name: F.get_json_object("x", path).alias(name)
    return found.select("event_id", of("$.api_key", "secret"), of("$.note", "note"), of("$.list[0].plain", "plain"), of("$.list[0].in.My-Secret-Id", "deep"))


@query("""select doc_id, case when length(text) <= 500 then md5(text) else md5(text[:500] || '... [truncated, ' || length(text) || ' chars total]') end as digest from documents""")
def shortened_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", _digest(text.shortened(F.col("text"), 500)).alias("digest"))


@query("""select doc_id, case when doc_id % 2 = 0 then lang || ',' || source else lang end as files, 'done' as status from documents""")
def front_matter_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    many, one = F.concat(F.lit("target_files:\n  - "), "lang", F.lit("\n  - '"), "source", F.lit("'\n")), F.concat(F.lit('target_files: "'), "lang", F.lit('"\n'))
    made = F.concat(F.lit("---\n"), F.when(F.col("doc_id") % 2 == 0, many).otherwise(one), F.lit("status: done\n---\n"), "text")
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.front_matter_list(made, "target_files"), ",").alias("files"), text.front_matter_value(made, "status").alias("status"))


@query("""select doc_id, case when doc_id % 2 = 0 then length(source) + 13 else 0 end::int as prefix, md5(text) as digest from documents""")
def context_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("[Contesto: "), "source", F.lit("]\n"), "text")).otherwise(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", semantic.without_context(made).alias("prefix"), _digest(text.without_context_line(made)).alias("digest"))


@query(f"""select doc_id, case when n > 4505 then 'over_context' when ceil(n / 12) > 250 then 'too_many_chunks' else 'ok' end as state from (select doc_id, {sql.tokens("coalesce(text, '')")} as n from documents)""")
def document_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = text.tokens(F.coalesce("text", F.lit("")))
    return load(spark, sf_dir, "documents").select("doc_id", budgets.document_state(total, F.lit(8192), F.lit(12)).alias("state"))


_ROOM = "(context - 1 - 1024 - 128)"


@query(f"""select doc_id, context, case when {_ROOM} < 256 then 'no_room' when n > {_ROOM} and greatest(1, length(cut) // 4) > {_ROOM} then 'over' when n > {_ROOM} then 'cut' else 'ok' end as state,
    case when {_ROOM} >= 256 then md5(case when n > {_ROOM} then cut else text end) end as digest from (select *, case when length(text) <= 4 * {_ROOM} then text else text[:4 * {_ROOM} // 2] || chr(10) || chr(10) || '_[… passo troncato: ' || (length(text) - 4 * {_ROOM}) || ' caratteri omessi …]_'
    || chr(10) || chr(10) || right(text, 4 * {_ROOM} // 2) end as cut from (select doc_id, text, {sql.tokens('text')} as n, unnest([1300, 2048, 8192]) as context from documents))""")
def payload_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = F.explode(F.array(*[F.lit(n) for n in (1300, 2048, 8192)])).alias("context")
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", contexts)
    found = rows.select("doc_id", "context", budgets.fitted_payload(F.col("context"), F.lit("go"), F.col("text"), 1024, "passo").alias("x"))
    return found.select("doc_id", "context", "x.state", _digest(F.col("x.user")).alias("digest"))


@query(f"""select source, case when source is null then 5000 else (case when source = 'src1' then 131072 else 8192 end) * 65 // 100 end::int as tokens from (select distinct source from documents)""")
def synthesis_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("source") == "src1", "model-128k").otherwise(F.col("source"))
    return load(spark, sf_dir, "documents").select("source").distinct().select("source", budgets.synthesis_budget(model).alias("tokens"))


@query(f"""with m as (select user_id, list(model order by place) as models from (select distinct user_id, event_id % 8 as place, ({MODELS!r})[event_id % 8 + 1] as model from events where event_id % 7 < 3) group by user_id)
    select user_id, task, coalesce(list_filter(models, lambda m: contains(m, w1))[1], list_filter(models, lambda m: contains(m, w2))[1], list_filter(models, lambda m: contains(m, w3))[1], case when w4 <> '' then list_filter(models, lambda m: contains(m, w4))[1] end,
        list_filter(models, lambda m: not regexp_matches(m, 'vl|vision|multimodal|mm-'))[1], models[1]) as model
    from m, (values ('reasoning', 'qwen', 'deepseek', 'mistral-nemo', 'llama-3'), ('summary', 'phi', 'gemma', 'llama-3.2', ''), ('fast', 'phi', 'smollm', 'qwen2.5-3b', ''), ('other', '~', '~', '~', '')) t(task, w1, w2, w3, w4)""")
def model_for_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's models, in an order, and the one for each kind of task."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % 8 + 1).cast("int"))
    rows = load(spark, sf_dir, "events").where("event_id % 7 < 3").select("user_id", F.struct((F.col("event_id") % 8).alias("place"), model.alias("model")).alias("m")).distinct()
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("ms")).select("user_id", F.transform("ms", lambda m: m["model"]).alias("models"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("task"), budgets.model_for(t, F.col("models")).alias("model")) for t in ("reasoning", "summary", "fast", "other")])).alias("x")
    return lists.select("user_id", each).select("user_id", "x.*")


_RANK = "case when regexp_matches(model, 'vl|vision|multimodal|mm-') then 10 when regexp_matches(model, 'instruct|chat') then 0 else 5 end"


@query(f"""with m as (select user_id, ({MODELS!r})[event_id % 8 + 1] as model, event_id % 13 = 0 as loaded, event_id % 17 = 0 as active, event_id from events where event_id % 7 < 2),
    c as (select *, {_RANK} as r from m where not regexp_matches(model, 'embed|e5-'))
    select u.user_id, coalesce((select model from c where c.user_id = u.user_id and loaded order by r, model limit 1), (select model from c where c.user_id = u.user_id and active order by event_id limit 1), (select model from c where c.user_id = u.user_id order by r, model limit 1), 'local-model') as model
    from (select distinct user_id from events) u""")
def discovered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that each user's server would run: loaded, in use, preferred, or the fallback."""
    model = F.element_at(F.array(*[F.lit(m) for m in MODELS]), (F.col("event_id") % 8 + 1).cast("int"))
    state = F.when(F.col("event_id") % 17 == 0, "active").otherwise("idle")
    rows = load(spark, sf_dir, "events").withColumn("m", F.when(F.col("event_id") % 7 < 2, F.struct("event_id", model.alias("model"), (F.col("event_id") % 13 == 0).alias("loaded"), state.alias("state"))))
    lists = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return lists.select("user_id", budgets.discovered(F.col("ms"), "local-model").alias("model"))


@query("""with h as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n, '### RAG ' || row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) || ': ' || o_orderkey || ' (score=0.500)' || chr(10) || chr(10) || repeat(o_orderpriority || ' ', 9) || o_orderstatus || chr(10) as block from orders),
    u as (select *, 16 + sum(length(block)) over (partition by o_custkey order by n) as used from h)
    select o_custkey, md5('## Contesto RAG' || chr(10) || coalesce(chr(10) || string_agg(block, chr(10) order by n) filter (where used <= 800), '') || case when count(*) filter (where used > 800) > 0 then chr(10) || '_… altri ' || count(*) filter (where used > 800) || ' chunk RAG omessi (budget 800 char)_' || chr(10) else '' end) as digest from u group by o_custkey""")
def rag_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as ranked hits under a budget of 800 code points."""
    body = F.concat(F.repeat(F.concat("o_orderpriority", F.lit(" ")), F.lit(9)), "o_orderstatus")
    hits = load(spark, sf_dir, "orders").select("o_custkey", F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey").alias("rank"), F.col("o_orderkey").cast("string").alias("title"), F.lit(0.5).alias("score"), body.alias("text"))
    return retrieval.rag_context(hits, "o_custkey", "rank", 800).select("o_custkey", _digest(F.col("context")).alias("digest"))


@query("""select user_id, 'd' || event_id as location, event_type as title from events where event_id % 50 = 0 union all select user_id, 'n' || event_id, null from events where event_id % 50 = 0""")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested listing of each fiftieth event: one document twice, one deep inside."""
    number = F.col("event_id").cast("string")
    doc = F.struct(F.concat(F.lit("d"), number).alias("location"), F.col("event_type").alias("title"))
    deep = F.struct(F.struct(F.array(F.struct(F.concat(F.lit("n"), number).alias("docpath"))).alias("items")).alias("folder"))
    raw = F.to_json(F.struct(F.array(doc, doc).alias("files"), F.array(deep).alias("more"), F.lit(1).alias("count")))
    return retrieval.listed_documents(load(spark, sf_dir, "events").where("event_id % 50 = 0").select("user_id", raw.alias("raw")), "raw", "user_id")


@query("""select conv_id, case when count(*) > 1 then md5('# File grezzo' || chr(10) || '`c' || conv_id || '` — analizzato in **' || count(*) || '** parti (chunk).' || chr(10) || chr(10) || '# Riferimenti SOT consultati' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || '# Report per chunk (da consolidare senza perdere contesto)' || chr(10) || chr(10) || string_agg(coalesce(text, ''), chr(10) order by turn)[:12000] || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'Produci il report consolidato unico, ricco, pronto per handoff a Claude/GPT.') end as digest from conversations group by conv_id""")
def consolidation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("ts"))
    prompt = reports.consolidation_prompt(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.array_join(F.transform("ts", lambda t: t["t"]), "\n"), F.array(F.lit("a"), F.lit("b")), F.col("n"))
    return parts.select("conv_id", _digest(prompt).alias("digest"))


@query("""select conv_id, turn, md5(coalesce(string_agg(coalesce(text, ''), chr(10) || chr(10)) over (partition by conv_id order by turn rows between 2 preceding and 1 preceding), '')) as digest from conversations""")
def sliding_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("condensed"))
    return workflows.sliding_context(rows, "conv_id", "turn", "condensed").select("conv_id", "turn", _digest(F.col("context")).alias("digest"))


@query("""with recursive t as (select conv_id, turn, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn) as n from conversations),
    m as (select conv_id, turn, n, sha256(text)[:8] as fact, sha256(text) as history from t where n = 1 union all select t.conv_id, t.turn, t.n, sha256(t.text)[:8], sha256(history || t.text) from m join t on t.conv_id = m.conv_id and t.n = m.n + 1) select conv_id, turn, fact, history from m""")
def rolling_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn is read with the history that the one before it left."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return workflows.remembered(rows, "conv_id", "turn", "text").select("conv_id", "turn", F.col("facts")[0].alias("fact"), "history")


@query("""select page_id, md5('---' || chr(10) || 'source_file: "' || url || '"' || chr(10) || 'source_ext: ".html"' || chr(10) || 'pipeline: documents' || chr(10) || '---' || chr(10) || chr(10) || '# Sorgente: ' || string_split(url, '/')[-1] || chr(10) || chr(10) || html || chr(10)) as digest,
    regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') as stem, sha256(url)[:16] as key from pages where url is not null and html <> ''""")
def source_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sources: their Markdown, and the stem and digest of which a staging name is made."""
    rows = load(spark, sf_dir, "pages").where("url is not null and html <> ''")
    name = text.staging_name(F.col("url"))
    stem = F.regexp_replace(F.element_at(F.split("url", "/"), -1), r"(?<=.)\.[^.]*$", "")
    return rows.select("page_id", _digest(reports.source_document(F.col("url"), F.lit(".HTML"), F.col("html"))).alias("digest"), stem.alias("stem"), F.regexp_extract(name, r"__([0-9a-f]{16})\.md$", 1).alias("key"))


@query("""select doc_id, md5(case when doc_id % 2 = 0 then '---x' || text else '---' || chr(10) || 'h' || chr(10) || '---' || chr(10) || regexp_replace(text, '^\\s+', '') end) as digest from documents where text is not null and not regexp_matches(text, '^\\s*---')""")
def spec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header before each document that has none."""
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("---x"), "text")).otherwise(F.col("text"))
    rows = load(spark, sf_dir, "documents").where(F.col("text").isNotNull() & ~F.col("text").rlike(r"^\s*---"))
    return rows.select("doc_id", _digest(reports.with_front_matter(body, F.lit("---\nh\n---\n"))).alias("digest"))


@query(f"""select conv_id, place, md5(text) as digest from (select conv_id, row_number() over (partition by conv_id order by turn)::int as place, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## File grezzo: `t' || turn || '`' || chr(10) || chr(10) || {sql.stripped("coalesce(text, '')")} || chr(10) as text from conversations
    union all select distinct conv_id, 0, '# Report' from conversations)""")
def general_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", reports.report_entry(F.concat(F.lit("t"), F.col("turn").cast("string")), F.coalesce("text", F.lit(""))).alias("text"))
    return reports.general_report(rows, F.lit("# Report"), "turn", "conv_id").select("conv_id", "place", _digest(F.col("text")).alias("digest"))


@query("select doc_id from documents where doc_id not in (select doc_id from labels where doc_id is not null)")
def unwritten_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports that aren't there yet; those there stay."""
    return reports.only_new(load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels"), "doc_id")


@query(f"""select doc_id, md5('# Blog Post' || case when coalesce(source, '') <> '' then chr(10) || chr(10) || '- **Sorgente:** `' || source || '`' else '' end || case when b = '' then chr(10) else chr(10) || chr(10) || b end) as digest from (select doc_id, source, {sql.stripped("coalesce(text, '')")} as b from documents)""")
def workflow_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", _digest(reports.workflow_body(F.col("text"), F.lit("blog_post"), F.col("source"))).alias("digest"))


@query("""select conv_id, md5('# Estrazione multi-parte: c' || chr(10) || chr(10) || string_agg('## Parte ' || n || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by n)) as digest from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) group by conv_id""")
def joined_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("ts"))
    return parts.select("conv_id", _digest(reports.joined_parts(F.lit("c"), F.transform("ts", lambda t: t["t"]))).alias("digest"))


_BLOCKS = """select l_orderkey as doc, l_partkey % 2 as page, l_partkey * 10 + l_linenumber as block, round(l_discount * 100)::int as y0, round(l_tax * 100)::int as x0, case when l_suppkey % 3 = 0 then 'image' else 'text' end as kind, l_returnflag || l_linestatus as text, case when l_suppkey % 3 = 0 and l_quantity > 20 then l_linenumber % 2 end as xref from lineitem"""


def _pages(source: str) -> str:
    return f"""with b as (select *, row_number() over (partition by doc, page order by round(y0, 2), round(x0, 2), block) as place from ({source})),
    f as (select *, kind = 'image' and (xref is null or row_number() over (partition by doc, page, kind, xref order by place) = 1) as new from b),
    n as (select *, count(*) filter (where new) over (partition by doc order by page, place) as n from f),
    p as (select *, case when kind = 'image' then '[IMG_REF:img_' || lpad((case when xref is null then n else min(n) over (partition by doc, page, kind, xref) end)::varchar, 3, '0') || ']' else text end as part from n)
    select doc, page, md5(string_agg(part, chr(10) || chr(10) order by place)) as digest from p group by doc, page"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as blocks of pages."""
    image = F.col("l_suppkey") % 3 == 0
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 2).alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("block"), F.round(F.col("l_discount") * 100).cast("int").alias("y0"), F.round(F.col("l_tax") * 100).cast("int").alias("x0"),
        F.when(image, "image").otherwise("text").alias("kind"), F.concat("l_returnflag", "l_linestatus").alias("text"), F.when(image & (F.col("l_quantity") > 20), F.col("l_linenumber") % 2).alias("xref"))


@query(_pages(_BLOCKS))
def page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.numbered_pages(_blocks(spark, sf_dir)).select("doc", "page", _digest(F.col("body")).alias("digest"))


@query(_pages(f"""{_BLOCKS} union all select doc, page, min(ord), 1000000000, 1000000000, 'image', null, xref from (select l_orderkey as doc, l_partkey % 2 as page, l_partkey * 10 + l_linenumber as ord, l_linenumber % 4 as xref from lineitem where l_suppkey % 3 = 1)
    where (doc, page, xref) not in (select (doc, page, xref) from ({_BLOCKS}) where kind = 'image' and xref is not null) group by doc, page, xref"""))
def all_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the images that none of their blocks shows behind their bodies."""
    rows = load(spark, sf_dir, "lineitem").where("l_suppkey % 3 = 1")
    images = rows.select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 2).alias("page"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"), (F.col("l_linenumber") % 4).alias("xref"))
    return layout.numbered_pages(layout.with_unreferenced(_blocks(spark, sf_dir), images), dealt_out=True).select("doc", "page", _digest(F.col("body")).alias("digest"))


@query("""with b as (select l_orderkey as doc, round(l_extendedprice * 100)::bigint as block, round(l_discount * 100)::int as x0, round(l_tax * 100)::int as y0, x0 + 3 as x1, y0 + 3 as y1 from lineitem where l_suppkey % 2 = 0), i as (select l_orderkey as doc, round(l_extendedprice * 100)::bigint as ord, l_partkey as xref, round(l_discount * 100)::int as x0, round(l_tax * 100)::int as y0, x0 + 5 as x1, y0 + 2 as y1 from lineitem where l_suppkey % 2 = 1)
    select doc, block, (select xref from i where i.doc = b.doc and least(b.x1, i.x1) > greatest(b.x0, i.x0) and least(b.y1, i.y1) > greatest(b.y0, i.y0) order by (least(b.x1, i.x1) - greatest(b.x0, i.x0)) * (least(b.y1, i.y1) - greatest(b.y0, i.y0)) desc, ord limit 1) as xref from b""")
def shown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each image box of a page the image that covers most of it."""
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("block"), F.col("l_partkey").alias("xref"), F.round(F.col("l_discount") * 100).cast("int").alias("x0"), F.round(F.col("l_tax") * 100).cast("int").alias("y0"), "l_suppkey")
    boxes = rows.where("l_suppkey % 2 = 0").select("doc", "block", "x0", "y0", (F.col("x0") + 3).alias("x1"), (F.col("y0") + 3).alias("y1"))
    images = rows.where("l_suppkey % 2 = 1").select("doc", F.col("block").alias("ord"), "xref", "x0", "y0", (F.col("x0") + 5).alias("x1"), (F.col("y0") + 2).alias("y1"))
    return layout.shown_image(boxes, images, ["doc"]).select("doc", "block", "xref")


@query("""select conv_id, md5('# Raw extraction — c' || chr(10) || chr(10) || '> V2 physical extract (PyMuPDF). Placeholder immagini: `[IMG_REF:img_NNN]`' || chr(10) || chr(10) || string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn) || chr(10)) as digest,
    count(*) filter (where length(coalesce(text, '')) < 50 and (role = 'user' or turn * 1000 >= 4096)) as n_scanned from conversations group by conv_id""")
def assembled_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages, put together, and how many of them would need character recognition."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("body"), "role")
    need = rows.groupBy("conv_id").agg(F.count_if(layout.needs_recognition(F.length("body"), F.col("role") == "user", F.col("turn") * 1000)).alias("n_scanned"))
    return layout.assembled(rows, F.lit("c"), "conv_id", "turn").select("conv_id", _digest(F.col("text")).alias("digest")).join(need, "conv_id")


@query(f"""select doc_id, md5('# Raw extraction — x.md' || chr(10) || chr(10) || '> V2 text intake (no PDF). Source: `x.md`' || chr(10) || chr(10) || '## Page 1' || chr(10) || chr(10) || {sql.stripped("coalesce(text, '')")} || chr(10)) as digest from documents""")
def plain_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", _digest(layout.plain_extract(F.lit("x.md"), F.coalesce("text", F.lit("")))).alias("digest"))


@query("""select count(*) filter (where doc_id % 9 > 0) as n_ok, count(*) filter (where doc_id % 9 = 0) as n_failed, case when count(*) = 0 then 'skipped' when count(*) filter (where doc_id % 9 > 0) > 0 then 'ok' else 'partial' end as status from documents""")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 == 0, "failed").alias("error"))
    return workflows.batch_status(rows)


@query("""select doc_id, 'plain-8k' as model, sha256(case when greatest(1, length(t) // 4) + 1 + 4096 < 2457 then t else t[:greatest(256, floor(length(t) * least(0.7, 2457.0 / (greatest(1, length(t) // 4) + 4097)))::int)] end) as answer from (select doc_id, coalesce(text, '') as t from documents)""")
def fallback_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first model answers; the prompt is cut to what it can take."""
    rows = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("prompt"))
    return workflows.with_fallbacks(rows, ["plain-8k", "mistral-32k-chat"]).select("doc_id", "model", "answer")


@query("""select conv_id, sha256(string_agg(reply, chr(10) order by turn)) as answer from (select conv_id, turn, '{"facts":[{"claim":"' || sha256(coalesce(text, '')) || '","confidence":"low","section":"?"}],"entities":[],"gaps_vs_sot":[],"open_questions":[],"parse_error":true,"chunk_index":' || turn || '}' as reply from conversations) group by conv_id""")
def refactored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies on turns put together by one more call; the stand-in's replies aren't JSON and are kept as facts."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    return workflows.refactored(rows, "conv_id", "turn", "text", 100_000).select("conv_id", "answer")


_SHORT = "case when length(t) <= {0} then t else t[:{0} // 2] || chr(10) || chr(10) || '_[… doc troncato: ' || (length(t) - {0}) || ' caratteri omessi …]_' || chr(10) || chr(10) || right(t, {0} // 2) end"


@query(f"""select doc_id, sha256('b' || chr(10) || chr(10) || sha256('a' || chr(10) || chr(10) || {_SHORT.format(24_000)})) as answer from (select doc_id, coalesce(text, '') as t from documents)""")
def chained_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow's answers are the next one's texts; long texts are cut in their middle."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return workflows.chained(docs, lambda d: workflows.single_call(d, 24_000, "a"), lambda d: workflows.single_call(d, 24_000, "b")).select("doc_id", "answer")


@query(" union all ".join(f"select doc_id, '{w}' as workflow, sha256('{w}' || chr(10) || chr(10) || {_SHORT.format(n)}) as answer from (select doc_id, coalesce(text, '') as t from documents)" for w, n in workflows.MOST_CHARS.items()))
def single_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflows that ask once about each text."""
    docs, out = load(spark, sf_dir, "documents").select("doc_id", "text"), None
    for name in workflows.MOST_CHARS:
        one = workflows.named_call(docs, name).select("doc_id", F.lit(name).alias("workflow"), "answer")
        out = one if out is None else out.unionByName(one)
    return out


@query("""select doc_id, case doc_id % 3 when 0 then 'Python' when 1 then 'Go' else 'testo' end as language, case when trim(coalesce(text, '')) <> '' then length(text) - length(replace(text, chr(10), '')) + 1 end::int as lines, 3 as n_missing, trim(coalesce(text, '')) = '' as failed from documents""")
def analysed_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(".py"), F.lit(".go"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/f"), kind).alias("path"), "text")
    found = workflows.analysed_code(files)
    return found.select("doc_id", "language", "lines", F.size("missing").alias("n_missing"), F.col("error").isNotNull().alias("failed"))


@query()
def gap_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's chunks against the first documents of one source as canon; a test holds it against Python."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    canon = docs.where("source = 'src1'").select(F.lit(1).alias("tier"), F.col("doc_id").cast("string").alias("rel"), "text")
    found = workflows.gap_report(docs.select("doc_id", "text"), canon, 1200)
    return found.select("doc_id", "n_parts", _digest(F.col("report")).alias("digest"))


@query()
def project_gap_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One language's documents as a project: those labelled good are its canon; a test holds the choice of the canon."""
    roles = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select("doc_id", F.when(F.col("quality") == 1, "SOT").alias("role"))
    files = load(spark, sf_dir, "documents").select(F.col("lang").alias("project"), "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"), "text").join(roles, "doc_id", "left")
    found = workflows.project_gap(files, "en", 1200)
    return found.select("doc_id", "n_parts", _digest(F.col("report")).alias("digest"))


@query(f"""select doc_id, md5(case when {sql.normalised('text')} = '' then 'doc ' || doc_id else {sql.normalised("text[:500000]")} end) as digest from documents""")
def signed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What signatures are made of; blank texts give their names."""
    return load(spark, sf_dir, "documents").select("doc_id", _digest(dedup.signed_text(F.concat(F.lit("Doc  "), F.col("doc_id").cast("string")), F.col("text"))).alias("digest"))


_ASK = "'# Documento: `' || conv_id || '`' || chr(10) || '# Frammento ' || n || ' di ' || m || ': `' || label || '`' || chr(10) || {0} || '## Testo del frammento' || chr(10) || chr(10) || text"
_BEFORE = "chr(10) || '---' || chr(10) || '**Contesto rolling (ultimi blocchi analizzati):**' || chr(10) || {0} || chr(10) || '---' || chr(10) || chr(10)"
_ONE, _TWO = "'### Blocco precedente -1' || chr(10) || c1", "'### Blocco precedente -2' || chr(10) || c2 || chr(10) || '### Blocco precedente -1' || chr(10) || c1"


@query(f"""with recursive t as (select conv_id, turn, coalesce(role, '') as label, coalesce(text, '') as text, row_number() over w as n, count(*) over (partition by conv_id) as m from conversations window w as (partition by conv_id order by turn)),
    s as (select conv_id, turn, n, sha256({_ASK.format("''")}) as a, sha256(sha256({_ASK.format("''")})) as c, null::varchar as d from t where n = 1
      union all select conv_id, turn, n, a, sha256(a), c1 from (select *, sha256({_ASK.format("case when c2 is null then " + _BEFORE.format(_ONE) + " else " + _BEFORE.format(_TWO) + " end")}) as a from (select t.*, s.c as c1, s.d as c2 from s join t on t.conv_id = s.conv_id and t.n = s.n + 1)))
    select conv_id, turn, a as analysis, c as condensed from s""")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns analysed one after another, each with the condensates of the two before it."""
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return workflows.sliding_window(rows, "conv_id", "turn", "role", "text").select("conv_id", "turn", "analysis", "condensed")
