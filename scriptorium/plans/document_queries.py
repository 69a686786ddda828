"""Queries of names, headings, replies and prompts of single documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import budgets, text
from scriptorium.operators import retrieval, state
from scriptorium.plans import sql
from scriptorium.plans.chunk_queries import markdown
from scriptorium.plans.registry import query
from scriptorium.sources.tables import load

STEMS = ["summary", "risk", "the", "que"]
TYPES = [".py", ".TSX", ".sql", ".tar.gz", ""]


@query("select array_to_string(string_split(url, '/')[1:2], '/') as macro, count(*) as n from pages group by 1")
def macro_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(text.macro_key(F.col("url")).alias("macro")).agg(F.count("*").alias("n"))


@query(r"select p_partkey, translate(replace(replace(lower(p_brand || '\' || p_name || ' & Co'), '\', '/'), '&', 'and'), ' -', '__') as name from part")
def match_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat("p_brand", F.lit("\\"), "p_name", F.lit(" & Co"))
    return load(spark, sf_dir, "part").select("p_partkey", text.match_name(made).alias("name"))


@query(f"select conv_id, 'Conversation ' || conv_id as heading, md5(array_to_string(string_split(trim(text), chr(10))[1:12], chr(10))) as digest from ({sql.VIEW})")
def compact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown(spark, sf_dir).select("conv_id", text.first_heading(F.col("text")).alias("heading"), F.md5(text.compact_index(F.col("text")).cast("binary")).alias("digest"))


@query(f"select doc_id, array_to_string(list_filter({STEMS!r}, lambda s: not contains(lower(text), s)), ',') as missing from documents")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(text.missing_sections(F.col("text"), STEMS), ",").alias("missing"))


@query("""select conv_id, turn, array_to_string(list_filter(heads, lambda h: contains(lower(t), h) and not contains(t[1:length(h) + 2], h)), ',') as refs
    from (select conv_id, turn, role || ' to ' || upper(lead(role, 1, 'none') over (partition by conv_id order by turn)) as t, ['assistant', 'system', 'user'] as heads from conversations)""")
def cross_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.lit(x) for x in ("assistant", "system", "user")])
    after = F.expr("upper(lead(role, 1, 'none') over (partition by conv_id order by turn))")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", F.lit(" to "), after).alias("t"))
    return rows.select("conv_id", "turn", F.array_join(text.cross_refs(F.col("t"), heads), ",").alias("refs"))


@query()
def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows end where the one before it did; a test holds them against Python."""
    parts = markdown(spark, sf_dir).select("conv_id", F.posexplode(text.windows(F.col("text"), 600)).alias("part", "text"))
    return parts.select("conv_id", "part", F.md5(F.col("text").cast("binary")).alias("digest"))


_KIND = "lower(regexp_extract('src/p' || p_partkey || ({0!r})[p_partkey % 5 + 1], '[^/.](\\.[^./]+)$', 1))".format(TYPES)


@query(f"""select p_partkey, coalesce(element_at(map({list(text.LANGUAGES)!r}, {list(text.LANGUAGES.values())!r}), k)[1], nullif(ltrim(k, '.'), ''), 'testo') as language from (select p_partkey, {_KIND} as k from part)""")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return load(spark, sf_dir, "part").select("p_partkey", text.language_of(F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), kind)).alias("language"))


@query("""select event_id, case event_id % 3 when 0 then event_type || chr(10) || 'end' else event_type end as answer from events""")
def reply_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = F.array(
        F.lit('{"output": [{"type": "message", "content": "%s"}, {"type": "reasoning", "content": "x"}, {"type": "message", "content": "end"}]}'),
        F.lit('{"response": " ", "content": 5, "text": " %s "}'),
        F.lit('{"output": "%s"}'),
    )
    raw = F.replace(F.element_at(shapes, (F.col("event_id") % 3 + 1).cast("int")), F.lit("%s"), F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", text.answer_text(raw).alias("answer"))


_ROOM = "(8192 - 1474 - 1500 - 128)"
_MOST = f"(4 * ({_ROOM} - 1))"


@query(f"""select doc_id, md5(case when greatest(1, (length(text) + 2) // 4) <= {_ROOM} or length(text) <= {_MOST} then text else text[:{_MOST} // 2] || chr(10) || chr(10) || '_[… prompt_utente troncato: '
    || (length(text) - {_MOST}) || ' caratteri omessi …]_' || chr(10) || chr(10) || right(text, {_MOST} // 2) end) as digest from documents""")
def fitted_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = budgets.fitted_prompt(F.lit("plain"), F.lit("go"), F.col("text"), 1500)
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(user.cast("binary")).alias("digest"))


@query("select distinct key from (select url as key from pages union all select string_split(regexp_replace(url, '(/\\.?)+$', ''), '/')[-1] from pages) where key is not null")
def store_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.document_keys(load(spark, sf_dir, "pages"), [F.col("url")])


@query("""select o_orderkey, case when o_orderstatus = 'F' then 'failed' when n is null then 'pending' else 'processing' end as status, case when o_orderstatus = 'F' then repeat('error ' || o_orderkey || ' ', 60)[:500] end as error,
    case when o_orderstatus <> 'F' and n is not null then n else 0 end as resume from orders left join (select l_orderkey, count(*) as n from lineitem where l_linenumber > 2 group by l_orderkey) on l_orderkey = o_orderkey""")
def failed_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their later lines as chunks that are done; some fail with a long message."""
    done = load(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = load(spark, sf_dir, "orders").join(done, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", "n", F.when(F.col("n").isNull(), "pending").otherwise("processing").alias("status"))
    message = F.repeat(F.concat(F.lit("error "), F.col("o_orderkey").cast("string"), F.lit(" ")), F.lit(60))
    marked = state.failed(rows, F.col("o_orderstatus") == "F", message)
    return marked.select("o_orderkey", "status", "error", state.resume_index(F.col("status"), F.col("n")).alias("resume"))


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("stage"), "ts", "event_id")
    return state.latest(rows, "stage", ["ts", "event_id"]).select("stage.user_id", "stage.event_type", "event_id")
