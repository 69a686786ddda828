"""Chunking: texts to ordered rows under token budgets, as folds over arrays of lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import SENTENCE_END, collapsed, tokens

BLANK_LINE = r"\n\s*\n"


#: Items that a fold takes before it lays aside what it has collected.
STRETCH = 256


def stretches(items: Column) -> Column:
    """An array as arrays of STRETCH items; the array is bound once, not made anew for each of them."""
    def cut(xs: Column) -> Column:
        parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / STRETCH).cast("int")))
        return F.transform(parts, lambda k: F.slice(xs, k * STRETCH + 1, F.lit(STRETCH)))

    return F.transform(F.array(F.struct(items.alias("xs"))), lambda b: cut(b["xs"]))[0]


def folded(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Column) -> Column:
    """The array that a fold collects: step(state, item) gives a struct of the next `state` and of `add`, an array to append.

    A growing array is copied by each step, so items are taken in stretches: one copies its own part only, and parts are
    laid side by side. n items cost n * (STRETCH + n / STRETCH^2) copies, not n * n. `out` is an empty array of what is added.
    """
    def one(a: Column, x: Column) -> Column:
        found = F.transform(F.array(step(a["state"], x)), lambda f: F.struct(f["state"].alias("state"), F.concat(a["out"], f["add"]).alias("out")))
        return found[0]

    def part(a: Column, xs: Column) -> Column:
        inner = F.aggregate(xs, F.struct(a["state"].alias("state"), out.alias("out")), one)
        return F.transform(F.array(inner), lambda f: F.struct(f["state"].alias("state"), F.array_append(a["outs"], f["out"]).alias("outs")))[0]

    empty = F.filter(F.array(out), lambda x: F.lit(False))
    return F.aggregate(stretches(items), F.struct(start.alias("state"), empty.alias("outs")), part, lambda a: F.flatten(a["outs"]))


def greedy_starts(items: Column, size: Callable[[Column], Column], joins: Callable[[Column, Column], Column]) -> Column:
    """The places (from 0) at which groups begin: an item joins the group before it if joins(state, size) holds.

    The state has total and last, the sizes of the group so far and of its last item. Sizes are made once.
    """
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    none = F.array().cast("array<int>")

    def step(a: Column, n: Column) -> Column:
        same = (a["i"] > 0) & joins(a, n)
        state = F.struct((a["i"] + 1).alias("i"), F.when(same, a["total"] + n).otherwise(n).alias("total"), n.alias("last"))
        return F.struct(state.alias("state"), F.when(same, none).otherwise(F.array(a["i"])).alias("add"))

    return folded(F.transform(items, lambda x: size(x).cast("long")), start, step, none)


def counted_before(items: Column, flag: Callable[[Column], Column]) -> Column:
    """Structs of each item and of n, how many items before it have the flag."""
    def step(a: Column, x: Column) -> Column:
        return F.struct((a + x).alias("state"), F.array(a).alias("add"))

    def both(xs: Column) -> Column:
        return F.zip_with(xs, folded(F.transform(xs, lambda x: flag(x).cast("int")), F.lit(0), step, F.array().cast("array<int>")), lambda x, n: F.struct(x.alias("item"), n.alias("n")))

    return F.transform(F.array(F.struct(items.alias("xs"))), lambda b: both(b["xs"]))[0]


def greedy_groups(items: Column, size: Callable[[Column], Column], joins: Callable[[Column, Column], Column]) -> Column:
    """For each item the number of its group, from 0."""
    own = slices(items, greedy_starts(items, size, joins))
    return F.flatten(F.transform(own, lambda xs, k: F.transform(xs, lambda x: k)))


def slices(items: Column, starts: Column) -> Column:
    """The items of each group, from where it begins to where the next does."""
    to = lambda s, xs: F.transform(s, lambda at, k: F.slice(xs, at + 1, F.coalesce(F.get(s, k + 1), F.size(xs)) - at))
    return F.transform(F.array(F.struct(starts.alias("s"), items.alias("xs"))), lambda b: to(b["s"], b["xs"]))[0]


def _grouped(items: Column, starts: Column, glue: str) -> Column:
    """The items of each group, joined."""
    return F.transform(slices(items, starts), lambda xs: F.array_join(xs, glue))


def sentences(text: Column) -> Column:
    """Sentences of a collapsed text.

    F.trim takes a second argument, what it trims; given to F.transform by name it would trim a sentence's own index.
    """
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, BLANK_LINE), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def packed_units(units: DataFrame, max_tokens: int, keys: list[str], unit: str = "units", glue: str = "\n\n") -> DataFrame:
    """`keys`, chunk (from 0), text and tokens: neighbouring units together while their tokens add up to max_tokens.

    A unit of more tokens is a chunk of its own. The packing of a document is one fold inside its row; nothing is shuffled.
    """
    groups = greedy_starts(F.col(unit), tokens, lambda a, n: a["total"] + n <= max_tokens)
    chunks = units.select(*keys, F.posexplode(_grouped(F.col(unit), groups, glue)).alias("chunk", "text"))
    return chunks.withColumn("tokens", tokens(F.col("text")))


def sentence_pack(docs: DataFrame, max_tokens: int = 100) -> DataFrame:
    """doc_id, lang, chunk, text, tokens of each distinct text (the first by doc_id), packed from its sentences."""
    from scriptorium.operators.dedup import first_of_each

    kept = first_of_each(docs)
    units = kept.select("doc_id", "lang", sentences(collapsed(F.col("text"))).alias("units"))
    return packed_units(units, max_tokens, ["doc_id", "lang"], glue=" ")


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section (from 0), title, text: a text cut at its headings of level two; what stands before is the preamble."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=##\s+\S)")
    strip = lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")
    named = F.transform(parts, lambda p, i: F.struct(F.when((i == 0), F.lit("preamble")).otherwise(F.trim(F.element_at(F.split(p, "\n"), 1))).alias("title"), strip(p).alias("text")))
    return docs.select(key, F.posexplode(F.filter(named, lambda s: s["text"] != "")).alias("section", "s")).select(key, "section", "s.title", "s.text")


def _folded(rows: DataFrame, key: str, order: str, joins: Callable[[Column, Column], Column], label: Callable[[Column], Column]) -> DataFrame:
    """Neighbouring rows of a key (its sections, so as many as a document holds) joined by a fold over their lengths."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), "title", "text"))).alias("xs"))
    starts = greedy_starts(F.col("xs"), lambda x: F.length(x["text"]) + 2, joins)
    again = lists.select(key, F.posexplode(slices(F.col("xs"), starts)).alias(order, "xs"))
    return again.select(key, order, label(F.col("xs")).alias("title"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n\n").alias("text"))


def _tokens_of(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4))


def merge_small(rows: DataFrame, min_tokens: int, key: str = "doc_id", order: str = "section") -> DataFrame:
    """Small neighbouring sections joined: all together at most 3 times min_tokens, and the last or the next below it."""
    # sizes count the two code points of a join with each text
    joins = lambda a, n: (_tokens_of(a["total"] + n - 2) <= 3 * min_tokens) & ((_tokens_of(a["last"] - 2) < min_tokens) | (_tokens_of(n - 2) < min_tokens))
    return _folded(rows, key, order, joins, lambda xs: xs[0]["title"])


def coalesce_chunks(rows: DataFrame, max_tokens: int, key: str = "doc_id", order: str = "section") -> DataFrame:
    """Neighbouring chunks joined while they have max_tokens at most."""
    joins = lambda a, n: _tokens_of(a["total"] + n - 2) <= max_tokens
    more = lambda xs: F.when(F.size(xs) == 1, xs[0]["title"]).otherwise(F.concat(xs[0]["title"], F.lit(" (+"), (F.size(xs) - 1).cast("string"), F.lit(" sez.)")))
    return _folded(rows, key, order, joins, lambda xs: F.substring(more(xs), 1, 80))


def paragraph_chunks(rows: DataFrame, max_tokens: int, keys: list[str], text: str = "text") -> DataFrame:
    """`keys`, chunk, text and tokens: paragraphs packed greedily; longer ones cut into slices of 4 * max_tokens, each a chunk."""
    step = 4 * max_tokens
    one = lambda x, alone: F.struct(x.alias("x"), F.lit(alone).alias("alone"))
    sliced = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / step).cast("int")), lambda i: one(F.substring(p, i * step + 1, F.lit(step)), True))
    units = F.flatten(F.transform(paragraphs(F.col(text)), lambda p: F.when(tokens(p) > max_tokens, sliced(p)).otherwise(F.array(one(p, False)))))
    split = rows.select(*keys, units.alias("units"))
    size = lambda u: F.when(u["alone"], max_tokens + 1).otherwise(tokens(u["x"]))
    groups = greedy_starts(F.col("units"), size, lambda a, n: a["total"] + n <= max_tokens)
    chunks = split.select(*keys, F.posexplode(_grouped(F.transform("units", lambda u: u["x"]), groups, "\n\n")).alias("chunk", "text"))
    return chunks.withColumn("tokens", tokens(F.col("text")))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 0), offset in code points, and the line."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line", "content"))
    before = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)))


def fence_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, span (from 0), start and stop offsets of closed code fences."""
    order = Window.partitionBy(key).orderBy("line")
    marks = lines(docs, key, text).where(F.trim("content").startswith("```")).withColumn("n", F.row_number().over(order) - 1)
    pairs = marks.groupBy(key, F.floor(F.col("n") / 2).cast("int").alias("span"))
    return pairs.agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.length("content") + 1).alias("stop"), F.count("*").alias("m")).where("m = 2").drop("m")


def table_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, first_line, n_lines of runs of two or more lines that begin and end with a bar."""
    rows = lines(docs, key, text).where(F.trim("content").rlike(r"^\|.*\|$"))
    rows = rows.withColumn("run", F.col("line") - F.row_number().over(Window.partitionBy(key).orderBy("line")))
    return rows.groupBy(key, "run").agg(F.min("line").alias("first_line"), F.count("*").alias("n_lines")).where("n_lines >= 2").drop("run")


def heading_path(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line, level, title, h1 and h2 in force, for each heading of level one to three outside of code fences."""
    open_fences = F.sum(F.trim("content").startswith("```").cast("int")).over(Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    heads = lines(docs, key, text).withColumn("open", open_fences).where((F.col("open") % 2 == 0) & F.col("content").rlike(r"^#{1,3}\s+\S")).select(
        key, "line", F.length(F.regexp_extract("content", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("content", r"^#+\s+(.*)$", 1)).alias("title"))
    order = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    h1 = F.last(F.when(F.col("level") == 1, F.col("title")), ignorenulls=True).over(order)
    h2 = F.last(F.when(F.col("level") == 1, F.lit("")).when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(order)
    return heads.select(key, "line", "level", "title", F.coalesce(h1, F.lit("")).alias("h1"), F.coalesce(h2, F.lit("")).alias("h2"))


def with_overlap(chunks: DataFrame, key: str, order: str, chars: int) -> DataFrame:
    """Each chunk with the tail of the one before it, cut at a space if there is one."""
    before = F.lag("text").over(Window.partitionBy(key).orderBy(order))
    tail = F.regexp_replace(F.right(before, F.lit(chars)), r"^\S*\s", "")
    return chunks.withColumn("overlap", F.coalesce(tail, F.lit("")))


def linked(chunks: DataFrame, key: str, order: str, name: str = "chunk_id") -> DataFrame:
    """Each chunk with the names of its neighbours."""
    w = Window.partitionBy(key).orderBy(order)
    return chunks.withColumns({"previous_id": F.lag(name).over(w), "next_id": F.lead(name).over(w)})
