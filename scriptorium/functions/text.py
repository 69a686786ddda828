"""Scalar text functions as Spark expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The patterns of this module that results depend on.
#: All white space of Unicode, with the four information separators.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: What may not stand in a file name, and what may not stand in a slug.
NONWORD = r"[^\p{L}\p{N}_.\-]"
NONSLUG = r"[^\p{L}\p{N}_\s\-]"
CHARS_PER_TOKEN = 4
#: Fixed value: where one sentence ends and the next begins.
SENTENCE_END = r"(?U)(?<=[.!?…])\s+(?=[A-ZÀ-ÿ0-9\"'`(])"


def collapsed(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalised(text: Column) -> Column:
    """Lower case, collapsed; null: empty."""
    return collapsed(F.lower(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the code points, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def truncated_middle(text: Column, most: int | Column, label: str | Column) -> Column:
    """Head and tail of most // 2 code points each around a notice, if the text is longer than `most`."""
    half = F.floor(most / 2).cast("int") if isinstance(most, Column) else most // 2
    label = F.lit(label) if isinstance(label, str) else label
    notice = F.concat(F.lit("\n\n_[… "), label, F.lit(" troncato: "), (F.length(text) - most).cast("string"), F.lit(" caratteri omessi …]_\n\n"))
    tail = text if isinstance(half, int) and not half else F.right(text, F.lit(half))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), notice, tail))


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k code points of the normalised text; a shorter text is its only one.

    Runs are slices of the array of code points: reaching a place in a string takes time in proportion to the place.
    """
    points = F.regexp_extract_all(normalised(text), F.lit("(?s)."), 0)
    cut = lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(p) - (k - 1)), lambda i: F.array_join(F.slice(p, i, F.lit(k)), "")))
    return F.transform(F.array(points), lambda p: F.when(F.size(p) == 0, p).when(F.size(p) <= k, F.array(F.array_join(p, ""))).otherwise(cut(p)))[0]


@F.pandas_udf(T.IntegerType())
def _n_runs(text: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([len({x[i : i + n] for i in range(len(x) - n + 1)}) if len(x) > n else min(1, len(x)) for x, n in zip(text, k)], dtype="int32")


def n_char_shingles(text: Column, k: int = 5) -> Column:
    """Number of char_shingles; only counted, they need not be laid out as an array."""
    return _n_runs(normalised(text), F.lit(k))


def word_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k words of the normalised text; of fewer words, all of them together."""
    words = F.array_remove(F.split(normalised(text), " "), "")
    cut = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")))
    return F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, w).when(F.size(w) <= k, F.array(F.array_join(w, " "))).otherwise(cut(w)))[0]


def slug(name: Column) -> Column:
    s = F.regexp_replace(F.lower(collapsed(name)), NONSLUG, "")
    s = F.regexp_replace(F.regexp_replace(s, r"[-\s]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("project"))


def safe_segment(name: Column, fallback: str = "item") -> Column:
    """The last part of a path as a safe file name."""
    last = F.element_at(F.split(F.replace(F.trim(F.coalesce(name, F.lit(""))), F.lit("\\"), F.lit("/")), "/"), -1)
    safe = F.regexp_replace(F.regexp_replace(last, NONWORD + "+", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def report_name(rel: Column) -> Column:
    """GAP_<folder>_<stem>.md, cut at 120 code points before the prefix."""
    path = F.replace(rel, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, NONWORD + "+", "_"), "^_+|_+$", "")
    both = F.when(folder == "", clean(stem)).otherwise(F.concat(clean(folder), F.lit("_"), clean(stem)))
    return F.concat(F.lit("GAP_"), F.substring(both, 1, 120), F.lit(".md"))


def staging_name(rel: Column) -> Column:
    """<stem of 60 code points>__<16 digits of the path's digest>.md."""
    stem = F.regexp_replace(F.element_at(F.split(rel, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.concat(F.substring(F.regexp_replace(stem, NONWORD + "+", "_"), 1, 60), F.lit("__"), F.substring(F.sha2(rel.cast("binary"), 256), 1, 16), F.lit(".md"))


def redacted(value: Column) -> Column:
    """Bearer values and long opaque strings masked."""
    secret = (F.length(value) > 24) & value.rlike(r"^[A-Za-z0-9_\-]{20,}$")
    return F.when(value.rlike(r"(?i)^\s*bearer\s+\S+"), F.lit("[REDACTED]")).when(secret, F.lit("[REDACTED]")).otherwise(value)


def shortened(value: Column, most: int = 48_000) -> Column:
    return F.when(F.length(value) <= most, value).otherwise(F.concat(F.substring(value, 1, most), F.lit("... [truncated, "), F.length(value).cast("string"), F.lit(" chars total]")))


def without_fence(raw: Column) -> Column:
    """A text without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def image_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[IMG_REF:(img_\d+)\]"), 1))


def page_numbers(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^## Page (\d+)"), 1), lambda x: x.cast("int"))))


def first_heading(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#+([^\n]*)", 1))


def match_name(name: Column) -> Column:
    return F.translate(F.replace(F.replace(F.lower(name), F.lit("\\"), F.lit("/")), F.lit("&"), F.lit("and")), " -", "__")


def macro_key(rel: Column) -> Column:
    return F.array_join(F.slice(F.split(rel, "/"), 1, 2), "/")


def without_context_line(text: Column) -> Column:
    """A chunk without the line that repeats its heading."""
    return F.regexp_replace(text, r"^\[Contesto: [^\]]*\]\n", "")


def compact_index(body: Column, lines: int = 12) -> Column:
    return F.array_join(F.slice(F.split(F.trim(body), "\n"), 1, lines), "\n")


def missing_sections(report: Column, stems: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(s) for s in stems]), lambda s: ~F.contains(F.lower(report), s))


#: Lines of a front matter that make a text canonical, and keys under which a reply or a JSON text has its text.
CANON = [r"(?im)^category:\s*SOT\b", r"(?im)^status:\s*AUTHORITATIVE"]
TEXT_KEYS, REPLY_KEYS = ("content", "body", "text", "markdown"), ("response", "content", "text", "output")


def is_canon(text: Column) -> Column:
    """A front matter that names the text canonical, within its first 512 bytes."""
    head = F.make_valid_utf8(F.substring(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 1, 512).cast("string"))
    return head.rlike(CANON[0]) | head.rlike(CANON[1])


def front_matter_value(text: Column, key: str) -> Column:
    head = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.regexp_replace(F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1)), r'^"|"$', "")


def first_string(raw: Column, keys=TEXT_KEYS) -> Column:
    """The first of some keys of a JSON object whose value is a string, collapsed; null if there is none."""
    value = F.try_parse_json(raw)
    found = [F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string")) for k in keys]
    return collapsed(F.coalesce(*found))


def file_type(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


#: Languages by file type.
LANGUAGES = {
    ".py": "Python", ".pyw": "Python", ".js": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript",
    ".jsx": "JavaScript", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".swift": "Swift",
    ".sh": "Shell", ".ps1": "PowerShell", ".sql": "SQL",
}


def language_of(path: Column) -> Column:
    """The language that a path's type tells; else the type itself, and `testo` without one."""
    kind = file_type(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, kind), F.nullif(F.ltrim(kind, F.lit(".")), F.lit("")), F.lit("testo"))


def cross_refs(text: Column, headings: Column) -> Column:
    """Those of some headings that a text names, in whatever case, but doesn't begin with."""
    named = lambda h: F.contains(F.lower(text), F.lower(h)) & ~F.contains(F.substring(text, F.lit(1), F.length(h) + 2), h)
    return F.filter(headings, lambda h: (h != "") & named(h))


def pieces_of(text: str, most: int) -> list[tuple[int, str]]:
    """Place and text of each piece of `most` code points, or up to the last blank line beyond the first half of a piece;
    linear in the text."""
    if len(text) <= most:
        return [(0, text)]
    found, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        blank = text.rfind("\n\n", at, end) if end < len(text) else -1
        end = blank if blank > at + most // 2 else end
        found.append((at, text[at:end]))
        at = end
    return found


def windows(text: Column, most: int) -> Column:
    """A text in pieces of `most` code points, or up to the last blank line beyond the first half of a piece; null for null."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else [p for _, p in pieces_of(x, most)] for x in map(lambda c: c.as_py(), texts)], pa.list_(pa.string()))

    return cut(text)


@F.udtf(returnType=T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("body", T.StringType())]))
class _Pieces:
    """One row for each piece of a text; none for a null text."""

    def eval(self, text: str, most: int):
        if text is not None:
            for piece, (at, body) in enumerate(pieces_of(text, most)):
                yield piece, at, body


def text_pieces(docs: DataFrame, most: int, text: str = "text") -> DataFrame:
    """Every row of `docs` beside each piece of its text (piece from 0, at, body) in place of the text, as a lateral join with a
    table function.

    A text's pieces leave the worker one by one, so no array of them is held, and none carries the whole text; rows with a
    null text have no pieces."""
    return docs.lateralJoin(_Pieces(F.col(text).outer(), F.lit(most))).drop(text)


def answer_text(raw: Column) -> Column:
    """The text of a model's reply in JSON: its message blocks, else the first string of some keys; empty if there is none."""
    strip = lambda x: F.nullif(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit(""))
    value = F.try_parse_json(raw)
    blocks = F.filter(F.from_json(raw, "output array<struct<type string, content string>>")["output"], lambda b: b["type"] == "message")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["content"], F.lit(""))), "\n")
    keys = [F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{k}", "variant")) == "STRING", F.try_variant_get(value, f"$.{k}", "string")) for k in REPLY_KEYS]
    return F.coalesce(*map(strip, [joined, *keys]), F.lit(""))


#: What a reply that isn't JSON becomes: one fact of low confidence with its first 400 code points.
REPLY = "facts array<struct<claim string, confidence string, section string>>, entities array<string>, gaps_vs_sot array<string>, open_questions array<string>"


def parsed_reply(raw: Column, chunk: Column) -> Column:
    """A model's JSON reply, fenced or not, as a struct; a reply that doesn't parse is kept as a fact of low confidence."""
    bare = F.trim(raw)
    inner = F.trim(F.get(F.split(bare, "```"), F.lit(1)))
    inner = F.when(F.startswith(inner, F.lit("json")), F.trim(F.substring(inner, 5, 1 << 30))).otherwise(inner)
    text = F.when(F.startswith(bare, F.lit("```")), inner).otherwise(bare)
    good = F.try_parse_json(text).isNotNull()
    claim = F.struct(F.substring(text, 1, 400).alias("claim"), F.lit("low").alias("confidence"), F.lit("?").alias("section"))
    value, none = F.from_json(F.when(good, text), REPLY), F.array().cast("array<string>")
    return F.struct(
        F.when(good, value["facts"]).otherwise(F.array(claim)).alias("facts"), *[F.when(good, value[k]).otherwise(none).alias(k) for k in ("entities", "gaps_vs_sot", "open_questions")],
        (~good).alias("parse_error"), F.when(~good, chunk).alias("chunk_index"),
    )


def condensed_part(analysis: Column) -> Column:
    """What stands under the heading CONDENSATO, up to the next heading, if it has more than 30 code points; else null."""
    after = F.regexp_extract(analysis, r"(?s)## CONDENSATO\s*(.*)", 1)
    part = F.regexp_replace(F.get(F.split(after, "##"), F.lit(0)), r"^\s+|\s+$", "")
    return F.when(F.contains(analysis, F.lit("## CONDENSATO")) & (F.length(part) > 30), part)


def front_matter_list(text: Column, key: str) -> Column:
    """The items of a list in a front matter: lines of dashes below its key, or one value behind it."""
    head = F.concat(F.regexp_extract(text, r"(?s)^\s*---\n(.*?)\n---\s*\n", 1), F.lit("\n"))
    below = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*\n)+)", 1)
    items = F.regexp_extract_all(below, F.lit(r"(?m)^[ \t]*-[ \t]+([^\n]*)$"), 1)
    inline = F.trim(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*([^\n]*)$", 1))
    bare = lambda x: F.regexp_replace(F.trim(x), r"""^["']|["']$""", "")
    return F.filter(F.transform(F.when(F.size(items) > 0, items).otherwise(F.array(inline)), bare), lambda x: x != "")


#: Names whose values are secret (compared with - for _, so those with _ never match), and bounds of a payload.
SECRET_KEYS = ["authorization", "api_key", "api-key", "apikey", "x-api-key", "token", "access_token", "refresh_token", "password", "secret", "bearer"]
MOST_DEPTH, MOST_ITEMS = 12, 200


@F.arrow_udf(T.StringType())
def redacted_json(raw: pa.Array) -> pa.Array:
    """JSON payloads with secret values masked at any depth, long lists and strings cut; what isn't JSON counts as a string."""

    def masked(text: str) -> str:
        if re.match(r"(?i)bearer\s+\S+", text.strip()) or (len(text) > 24 and re.fullmatch(r"[A-Za-z0-9_\-]{20,}", text)):
            return "[REDACTED]"
        return text if len(text) <= 48_000 else f"{text[:48_000]}... [truncated, {len(text)} chars total]"

    def walk(x, depth: int):
        if depth > MOST_DEPTH:
            return "[max depth]"
        if isinstance(x, dict):
            secret = lambda k: k in SECRET_KEYS or "api-key" in k or "apikey" in k or "secret" in k
            return {k: "[REDACTED]" if secret(k.lower().replace("_", "-")) else walk(v, depth + 1) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v, depth + 1) for v in x[:MOST_ITEMS]]
        return masked(x) if isinstance(x, str) else x

    out = []
    for text in raw.to_pylist():
        try:
            out.append(None if text is None else json.dumps(walk(json.loads(text), 0), ensure_ascii=False))
        except ValueError:
            out.append(masked(text))
    return pa.array(out, pa.string())


def bpe_counter(ranks_file: str, pattern: str, spark) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens under a vocabulary of ranks, read by the driver and broadcast."""
    import base64

    with open(ranks_file, "rb") as lines:
        shared = spark.sparkContext.broadcast({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    @F.arrow_udf(T.IntegerType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            yield pa.array([None if x is None else len(own.encode_ordinary(x)) for x in batch.to_pylist()], pa.int32())

    return count
