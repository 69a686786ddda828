"""Section chunks with structural overlap: the tail of the chunk before, cut at a paragraph, line or sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import tokens
from scriptorium.operators.chunking import coalesce_chunks, counted_before, fence_spans, greedy_starts, merge_small, paragraphs, sections, sentences, slices
from scriptorium.operators.semantic import stripped

OVERLAP = 400
#: Fixed value: the line before an overlap.
NOTICE = "[...contesto dal blocco precedente...]\n"
#: Code points that are looked at behind a boundary, and the widest white space before one.
AHEAD = 200
#: A place is a boundary before a line end, behind a blank line, and behind a sentence.
BOUNDARY = r"(?=\n)|(?<=\n\s{0,200}\n)(?!\s*\n)|(?<=[.!?…]\s{1,200})(?=[A-ZÀ-ÿ0-9\"'`(])"


def _packed(units: Column, max_tokens: int, label: Column, first_bare: bool) -> Column:
    """Units packed while their tokens fit together, as structs of label and text; parts are numbered in their order."""
    starts = greedy_starts(units, lambda u: F.when(u["alone"], max_tokens + 1).otherwise(tokens(u["x"])), lambda a, n: a["total"] + n <= max_tokens)
    alone = lambda g: g[0]["alone"]
    part = lambda n: F.concat(F.lit(" (part "), n.cast("string"), F.lit(")"))
    named = lambda g, n: F.when(alone(g), F.concat(label, F.lit(" (slice)"))).otherwise(F.concat(label, F.when((n == 0) & F.lit(first_bare), "").otherwise(part(n))))
    groups = counted_before(slices(units, starts), lambda g: ~alone(g))
    return F.transform(groups, lambda z: F.struct(named(z["item"], z["n"]).alias("title"), F.array_join(F.transform(z["item"], lambda u: u["x"]), "\n\n").alias("text")))


def by_paragraphs(text: Column, max_tokens: int, label: Column) -> Column:
    """Paragraphs packed under a budget; longer ones are cut into slices of 4 * max_tokens code points."""
    step = max(1, 4 * max_tokens)
    cut = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / step).cast("int")), lambda i: F.struct(F.substring(p, i * step + 1, F.lit(step)).alias("x"), F.lit(True).alias("alone")))
    units = F.flatten(F.transform(paragraphs(text), lambda p: F.when(tokens(p) > max_tokens, cut(p)).otherwise(F.array(F.struct(p.alias("x"), F.lit(False).alias("alone"))))))
    empty = F.array(F.struct(label.alias("title"), F.substring(text, 1, step).alias("text")))
    return F.when(F.size(units) == 0, empty).otherwise(_packed(units, max_tokens, label, False))


def at_safe_boundaries(text: Column, max_tokens: int, label: Column) -> Column:
    """A text that fits, whole; else its paragraphs packed under the budget, longer ones as their sentences, packed too.

    The sentences of a long paragraph aren't joined with its neighbours; a sentence longer than the budget stays whole.
    """
    def chunked(p: Column, long: Column) -> Column:
        starts = greedy_starts(sentences(p), tokens, lambda a, n: a["total"] + n <= max_tokens)
        parts = F.transform(slices(sentences(p), starts), lambda xs: F.array_join(xs, "\n\n"))
        many = F.transform(parts, lambda x, k: F.struct(x.alias("x"), F.lit(True).alias("alone"), F.when(k == 0, F.lit("")).otherwise(F.concat(F.lit(" (part "), k.cast("string"), F.lit(")"))).alias("tail")))
        return F.when(long, many).otherwise(F.array(F.struct(p.alias("x"), F.lit(False).alias("alone"), F.lit("").alias("tail"))))

    units = F.flatten(F.transform(paragraphs(text), lambda p: chunked(p, tokens(p) > max_tokens)))
    starts = greedy_starts(units, lambda u: F.when(u["alone"], max_tokens + 1).otherwise(tokens(u["x"])), lambda a, n: a["total"] + n <= max_tokens)
    tail = lambda g, n: F.when(g[0]["alone"], g[0]["tail"]).when(n == 0, F.lit("")).otherwise(F.concat(F.lit(" (part "), n.cast("string"), F.lit(")")))
    groups = counted_before(slices(units, starts), lambda g: ~g[0]["alone"])
    parts = F.transform(groups, lambda z: F.struct(F.substring(F.concat(label, tail(z["item"], z["n"])), 1, 80).alias("title"), F.array_join(F.transform(z["item"], lambda u: u["x"]), "\n\n").alias("text")))
    return F.when(tokens(text) <= max_tokens, F.array(F.struct(F.substring(label, 1, 80).alias("title"), text.alias("text")))).otherwise(parts)


def markdown_chunks(docs: DataFrame, max_tokens: int, min_tokens: int = 350, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section (from 0), title and text: a document that fits is one chunk; else its sections of level two, small ones
    merged, large ones cut by paragraphs, and neighbours joined while they fit; without such headings, its paragraphs."""
    body = F.col(text)
    fits, headed = tokens(body) <= max_tokens, body.rlike(r"(?m)^##\s+\S")
    short = docs.where(fits).select(key, F.lit(0).alias("section"), F.lit("full").alias("title"), body.alias("text"))
    plain = docs.where(~fits & ~headed).select(key, F.posexplode(by_paragraphs(body, max_tokens, F.lit("doc"))).alias("section", "x")).select(key, "section", "x.title", "x.text")
    merged = merge_small(sections(docs.where(~fits & headed), key, text), min_tokens, key)
    whole = F.array(F.struct(F.substring("title", 1, 80).alias("title"), F.col("text").alias("text")))
    parts = F.when(tokens(F.col("text")) <= max_tokens, whole).otherwise(by_paragraphs(F.col("text"), max_tokens, F.substring("title", 1, 40)))
    cut = merged.select(key, F.col("section").alias("s"), F.posexplode(parts).alias("p", "x"))
    cut = cut.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("s", "p")) - 1).alias("section"), "x.title", "x.text")
    return short.unionByName(plain).unionByName(coalesce_chunks(cut, max_tokens, key))


def refined(chunks: DataFrame, max_tokens: int, key: str = "doc_id", order: str = "section") -> DataFrame:
    """Chunks still over the budget cut at paragraphs and sentences, and all numbered anew."""
    parts = chunks.select(key, F.col(order).alias("s"), F.posexplode(at_safe_boundaries(F.col("text"), max_tokens, F.col("title"))).alias("p", "x"))
    return parts.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("s", "p")) - 1).alias(order), "x.title", "x.text")


def _repaired(segment: Column) -> Column:
    """A tail without half a fence: with an odd number of marks, what lies between the first and the last of them, or
    what follows the line of the only one."""
    bare = F.regexp_replace(segment, r"^\n+|\n+$", "")
    marks = F.size(F.split(bare, "```")) - 1
    rest = F.regexp_extract(bare, r"(?s)(```.*)", 1)
    one = F.when(F.contains(rest, F.lit("\n")), F.regexp_replace(rest, r"^[^\n]*\n", "")).otherwise(rest)
    return stripped(F.when(marks % 2 == 0, bare).when(marks > 1, F.regexp_extract(bare, r"(?s)(```.*```)", 1)).otherwise(one))


def overlap_tail(text: Column, spans: Column, most: int) -> Column:
    """The end of a text from the last boundary that leaves `most` code points or more behind it, and twice as many at
    most; boundaries inside of fences (`spans`: structs of start and stop) don't count.

    Boundaries are looked for by one regular expression in the window where they may lie, once for each stretch of it
    between fences.
    """
    n = F.length(text)
    least, rough = F.greatest(F.lit(0), n - 2 * most), n - most
    inside = lambda p: F.exists(spans, lambda s: (s["start"] <= p) & (p < s["stop"]))

    def last(upto: Column) -> Column:
        seen = F.substring(text, least + 1, upto - least + AHEAD)
        pattern = rf"(?s)^(.*)(?=.{{{AHEAD}}})(?:{BOUNDARY})"
        return F.when(seen.rlike(pattern), least + F.length(F.regexp_extract(seen, pattern, 1)))

    tops = F.concat(F.array(rough), F.transform(F.filter(spans, lambda s: (s["start"] > least) & (s["start"] <= rough)), lambda s: (s["start"] - 1).cast("int")))
    found = F.concat(F.transform(tops, last), F.filter(F.transform(spans, lambda s: s["stop"].cast("int")), lambda p: (p >= least) & (p <= rough)), F.array(F.when(least == 0, 0)))
    best = F.array_max(F.filter(found, lambda p: p.isNotNull() & ~inside(p)))
    out = F.filter(spans, lambda s: (s["start"] < rough) & (rough < s["stop"]))
    begin = F.coalesce(best, F.get(out, F.lit(0))["stop"].cast("int"), rough)
    return F.when((F.lit(most) <= 0) | (stripped(text) == ""), "").when(n <= most, _repaired(text)).otherwise(_repaired(F.substring(text, begin + 1, n)))


def with_structural_overlap(chunks: DataFrame, most: int = OVERLAP, key: str = "doc_id", order: str = "section") -> DataFrame:
    """Chunks with the number of code points taken over from the one before, and the text that begins with them."""
    ids = F.struct(key, order)
    spans = fence_spans(chunks.select(ids.alias("_id"), "text"), "_id").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("_spans"))
    with_spans = chunks.withColumn("_id", ids).join(spans, "_id", "left")
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    tails = with_spans.withColumn("_tail", overlap_tail(F.col("text"), F.coalesce("_spans", none), most))
    tail = F.coalesce(F.lag("_tail").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    return tails.select(*chunks.columns, F.length(tail).alias("overlap"), F.when(tail == "", F.col("text")).otherwise(F.concat(F.lit(NOTICE), tail, F.lit("\n\n"), F.col("text"))).alias("enriched"))


def overlapped_chunks(docs: DataFrame, max_tokens: int, most: int = OVERLAP, min_tokens: int = 350, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks of markdown_chunks(), refined to the budget, with structural overlap."""
    return with_structural_overlap(refined(markdown_chunks(docs, max_tokens, min_tokens, key, text), max_tokens, key), most, key)

