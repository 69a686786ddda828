"""Semantic chunks of Markdown: lines to sections by windows, sections to chunks by one fold over their tokens.

Code fences and bar tables are never cut, and nothing inside of them is a heading. A section is a heading line, or what
lies between two headings. Sections are packed up to a budget; each further chunk begins with a line that repeats the
heading in force.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import cross_refs, first_heading, image_refs, page_numbers, tokens
from scriptorium.operators.alike import first_of_alike
from scriptorium.operators.chunking import linked, slices
from scriptorium.operators.dedup import saved

#: Stand around a fence while lines are told apart; texts lose these two control characters.
_OPEN, _CLOSE = "\u0001", "\u0002"
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_BAR, _RULE = r"^\|[^\n]+\|$", r"^\|[-:\s|]+\|$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", "")


def marked_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, content, and block: the number of the fence or table that a line belongs to (null outside), and its kind.

    A fence is what lies between two marks of three backticks, wherever they stand. A table is a run of lines between
    bars whose second line is a rule, with one more line at least.
    """
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), _OPEN + _CLOSE, "")
    fenced = F.regexp_replace(plain, r"(?s)(```.*?```)", f"\n{_OPEN}$1{_CLOSE}\n")
    rows = docs.select(key, F.posexplode(F.split(fenced, _LINE_END)).alias("line", "content"))
    order = Window.partitionBy(key).orderBy("line")
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.sum(F.contains("content", F.lit(_OPEN)).cast("int")).over(so_far)
    closed = F.coalesce(F.sum(F.contains("content", F.lit(_CLOSE)).cast("int")).over(before), F.lit(0))
    rows = rows.select(key, "line", F.translate("content", _OPEN + _CLOSE, "").alias("content"), F.when(opened > closed, opened).alias("fence"))
    rows = rows.withColumn("bar", F.col("fence").isNull() & F.col("content").rlike(_BAR))
    rows = rows.withColumn("run", F.sum((~F.col("bar")).cast("int")).over(so_far))
    head = F.col("bar") & F.lead("bar", 1, False).over(order) & F.lead("bar", 2, False).over(order) & F.lead("content").over(order).rlike(_RULE)
    first = F.min(F.when(head, F.col("line"))).over(Window.partitionBy(key, "run"))
    rows = rows.withColumn("head", head).withColumn("table", F.when(F.col("bar") & (F.col("line") >= first), F.col("run")))
    kind = F.when(F.col("fence").isNotNull(), "code_fence").when(F.col("table").isNotNull(), "table")
    block = F.when(F.col("fence").isNotNull(), F.concat(F.lit("f"), "fence")).when(F.col("table").isNotNull(), F.concat(F.lit("t"), "table"))
    return rows.select(key, "line", "content", block.alias("block"), kind.alias("kind"))


def atomic_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, position (from 0), kind and text of the fences and tables of a text, in their order."""
    rows = marked_lines(docs, key, text).where("block is not null")
    blocks = rows.groupBy(key, "block", "kind").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", "content"))).alias("ls"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("line")) - 1
    return blocks.select(key, place.alias("position"), "kind", stripped(F.array_join(F.transform("ls", lambda x: x["content"]), "\n")).alias("text"))


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section (from 0), kind (heading, text, code_fence or table), heading in force and text; empty ones are left out.

    A section that is nothing but one fence or table is of that kind.
    """
    rows = marked_lines(docs, key, text)
    so_far = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("block").isNull() & F.col("content").rlike(r"^#{1,3}\s+\S")
    rows = rows.withColumn("is_head", is_head).withColumn("heading", F.last(F.when(F.col("is_head"), stripped(F.regexp_extract("content", r"^#{1,3}\s+(.+)$", 1))), True).over(so_far))
    rows = rows.withColumn("part", F.sum(F.col("is_head").cast("int")).over(so_far))
    of = rows.groupBy(key, "part", "is_head").agg(
        F.max("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("line", "content"))).alias("ls"), F.count_distinct("block").alias("blocks"),
        F.max("kind").alias("block_kind"), F.count_if(F.col("block").isNull() & (stripped(F.col("content")) != "")).alias("others"))
    body = F.array_join(F.transform("ls", lambda x: x["content"]), "\n")
    of = of.withColumn("text", F.when(F.col("is_head"), body).otherwise(stripped(body))).where("text <> ''")
    kind = F.when(F.col("is_head"), "heading").when((F.col("blocks") == 1) & (F.col("others") == 0), F.col("block_kind")).otherwise("text")
    place = F.row_number().over(Window.partitionBy(key).orderBy("part", F.desc("is_head"))) - 1
    return of.select(key, place.alias("section"), kind.alias("kind"), F.coalesce("heading", F.lit("")).alias("heading"), "text")


def _begins(sections: Column, max_tokens: int, min_tokens: int) -> Column:
    """Where chunks begin: a section that would go beyond the budget begins one, if the chunk has the least size already."""
    sizes = F.transform(sections, lambda s: F.struct(tokens(s["text"]).cast("long").alias("n"), F.when(s["heading"] == "", 0).otherwise(tokens(context_line(s["heading"]))).cast("long").alias("context")))
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["i"] > 0) & (a["total"] + x["n"] > max_tokens) & (a["total"] >= min_tokens)
        total = F.when(full, x["context"] + x["n"]).otherwise(a["total"] + x["n"])
        return F.struct((a["i"] + 1).alias("i"), total.alias("total"), F.when(full | (a["i"] == 0), F.array_append(a["out"], a["i"])).otherwise(a["out"]).alias("out"))

    return F.aggregate(sizes, start, step, lambda a: a["out"])


def context_line(heading: Column) -> Column:
    return F.concat(F.lit("[Contesto: "), heading, F.lit("]\n"))


def semantic_chunks(docs: DataFrame, max_tokens: int, min_tokens: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chunk (from 0), text, tokens, boundary, heading, has_code, has_table and cross_refs of each semantic chunk.

    A chunk's heading is the one in force when it was full, so that of the section after it; its boundary is the kind of
    the last lone fence or table so far, in whatever chunk. Sections larger than the budget aren't cut. A document is
    folded inside its row; its sections meet there, and nowhere else.
    """
    rows = markdown_sections(docs, key, text)
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "kind", "heading", "text"))).alias("xs"))
    lists = lists.withColumn("starts", _begins(F.col("xs"), max_tokens, min_tokens)).withColumn("headings", F.array_remove(F.array_distinct(F.transform("xs", lambda x: x["heading"])), ""))
    chunks = lists.select(key, "headings", F.posexplode(F.arrays_zip(slices(F.col("xs"), F.col("starts")).alias("own"), F.transform("starts", lambda s, k: F.get(F.col("xs"), F.get(F.col("starts"), k + 1))["heading"]).alias("after"))).alias("chunk", "z"))
    own = F.col("z.own")
    chunks = chunks.select(key, "headings", "chunk", own.alias("own"), F.coalesce(F.col("z.after"), F.element_at(own, -1)["heading"]).alias("heading"), own[0]["heading"].alias("first"))
    body = F.array_join(F.transform("own", lambda x: x["text"]), "\n")
    whole = stripped(F.when((F.col("chunk") > 0) & (F.col("first") != ""), F.concat(context_line(F.col("first")), F.lit("\n"), body)).otherwise(body))
    chunks = chunks.withColumn("text", whole).withColumn("lone", F.try_element_at(F.filter(F.transform("own", lambda x: x["kind"]), lambda k: k.isin("code_fence", "table")), F.lit(-1)))
    so_far = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    return chunks.select(
        key, "chunk", "text", tokens(F.col("text")).alias("tokens"), F.coalesce(F.last("lone", True).over(so_far), F.lit("paragraph")).alias("boundary"), "heading",
        F.contains("text", F.lit("```")).alias("has_code"), F.exists("own", lambda x: x["kind"] == "table").alias("has_table"), cross_refs(F.col("text"), F.col("headings")).alias("cross_refs"),
    ).where("text <> ''")


def without_context(text: Column) -> Column:
    """Code points of the line that repeats the heading, its end included; 0 without one."""
    close = F.locate("]\n", text)
    return F.when(F.startswith(text, F.lit("[Contesto:")) & (close > 0), close + 1).otherwise(0)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("i", "prefix", "char_start", "char_end")])))
def _spans(chunks: pa.Array, bodies: pa.Array) -> pa.Array:
    """Where each chunk of a document stands; a text is searched onward from the end of the chunk before."""
    found = []
    for xs, body in zip(chunks, bodies):
        spans, at, text = [], 0, body.as_py()
        for x in xs.as_py():
            begin = at
            if x["size"]:
                begin = next((p for p in (text.find(x["long"], at), text.find(x["short"], at)) if p >= 0), at)
            end = min(len(text), begin + x["size"])
            spans.append({"i": x["i"], "prefix": x["prefix"], "char_start": begin, "char_end": end})
            at = max(at, end)
        found.append(spans)
    return pa.array(found, pa.list_(pa.struct([(n, pa.int32()) for n in ("i", "prefix", "char_start", "char_end")])))


def located(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", order: str = "chunk", text: str = "text") -> DataFrame:
    """Chunks with label, prefix, char_start and char_end in the text that they come from.

    Each chunk is looked for, by its first 120 and then its first 40 code points, from where the one before it ended; one
    not found stands there itself. A document's probes come together beside its text, and nothing else of it.
    """
    prefix = without_context(F.col(text))
    raw = F.substring(F.col(text), prefix + 1, F.length(text))
    probes = F.struct(F.col(order).cast("int").alias("i"), prefix.alias("prefix"), F.length(raw).alias("size"), F.substring(raw, 1, 120).alias("long"), stripped(F.substring(raw, 1, 40)).alias("short"))
    lists = chunks.groupBy(key).agg(F.array_sort(F.collect_list(probes)).alias("xs"))
    spans = lists.join(docs.select(key, F.col(text).alias("body")), key).select(key, F.inline(_spans(F.col("xs"), F.col("body"))))
    return chunks.join(spans.withColumnRenamed("i", order), [key, order]).withColumn("label", F.substring(F.when(F.col("heading") != "", F.col("heading")).otherwise(F.concat(F.lit("chunk_"), F.col(order) + 1)), 1, 80))


def deduped_spans(docs: DataFrame, max_tokens: int, min_tokens: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Semantic chunks of each document without those that are like an earlier one of it, with their places in the text.

    A text without any chunk is one chunk, named full."""
    chunks = saved(first_of_alike(semantic_chunks(docs, max_tokens, min_tokens, key, text), key, "chunk", text))
    bare = docs.where(F.col(text).isNotNull()).join(chunks.select(key), key, "left_anti").select(key, F.lit(0).alias("chunk"), F.col(text), F.lit("full").alias("label"), F.lit(0).alias("prefix"), F.lit(0).alias("char_start"), F.length(text).alias("char_end"))
    return located(chunks, docs, key, "chunk", text).select(*bare.columns).unionByName(bare)


def raw_extract_chunks(docs: DataFrame, max_tokens: int, min_tokens: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunk entries of a raw extract: chunk_id, paths, section, pages, sizes, assets, tags, and links to their neighbours."""
    chunks = semantic_chunks(docs, max_tokens, min_tokens, key, text)
    name = F.format_string("chunk_%03d", F.col("chunk") + 1)
    tags = F.array_compact(F.array(F.when(F.col("has_code"), "code"), F.when(F.col("has_table"), "table"), F.when(F.size(image_refs(F.col("text"))) > 0, "image_ref")))
    rows = chunks.select(
        key, "chunk", name.alias("chunk_id"), F.concat(F.lit("chunks/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("enriched/"), name, F.lit(".enriched.md")).alias("enriched_path"),
        F.when(F.col("heading") != "", F.col("heading")).otherwise(first_heading(F.col("text"))).alias("section"), page_numbers(F.col("text")).alias("pages"),
        F.length("text").alias("char_count"), F.col("tokens").alias("token_estimate"), image_refs(F.col("text")).alias("assets"), tags.alias("semantic_tags"), "text",
    )
    return linked(rows, key, "chunk", "chunk_id")
