"""Files as rows: scans by folder, file type and size, and their texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions.text import collapsed, file_type, first_string
from scriptorium.sources.office import docx_text

#: File types that are read, and the size from which a file is refused.
TYPES = [".md", ".markdown", ".txt", ".pdf", ".docx", ".html", ".htm", ".json", ".xml", ".csv", ".log"]
#: Folders that aren't read; further ones are a parameter.
SKIPPED = [".git", ".venv", "venv", "node_modules", "__pycache__", ".cursor", "qdrant_storage", "agent-tools", ".staging_md", "data", "dist", "build", ".haystack", "projects", "legacy", "docs"]
#: Types whose bytes are their text.
PLAIN = [".md", ".markdown", ".txt", ".xml", ".csv", ".log"]
MOST_JSON = 50_000
MOST_BYTES = 8 * 1024 * 1024


def scan(spark: SparkSession, root: str, types=TYPES, most_bytes: int | None = None, skipped=SKIPPED) -> DataFrame:
    """path, rel, type, length, content of the files below a folder; Spark's readers skip files without bytes and those whose names begin with . or _.

    Rows come as the readers deal them out; in_order() sorts them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    rows = files.select("path", rel.alias("rel"), file_type(F.col("path")).alias("type"), "length", "modificationTime", "content")
    rows = rows.where(F.col("type").isin(*types) & ~F.arrays_overlap(F.split("rel", "/"), F.array(*[F.lit(s) for s in skipped])))
    return rows if most_bytes is None else rows.where(F.col("length") <= most_bytes)


def in_order(files: DataFrame) -> DataFrame:
    """Scanned files sorted by their paths, folder by folder; a global sort by ranges."""
    return files.orderBy(F.split("rel", "/"))


def _quoted(text: str) -> str:
    return r"\Q" + text.removeprefix("file://") + r"\E"


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


#: The & of a character reference that lacks its semicolon, or that is none.
BARE = re.compile(r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)")


def html_text(html: str | None, bare: bool = True) -> str | None:
    """Text nodes outside of scripts and styles, one to a line; without `bare`, references lacking their semicolon are plain text."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html if bare else BARE.sub("&amp;", html))
    parser.close()
    return "\n".join(parser.parts)


def html_to_text(rows: DataFrame, html: str = "html", text: str = "text", bare: bool = True) -> DataFrame:
    """Rows with the collapsed text of their HTML in place of it; `bare` as for html_text."""
    names = [c for c in rows.columns if c not in (html, text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array([html_text(x, bare) for x in batch.column(html).to_pylist()], pa.string())], names=[*names, text])

    found = rows.select(*names, html).mapInArrow(run, T.StructType([*[rows.schema[c] for c in names], T.StructField(text, T.StringType())]))
    return found.withColumn(text, collapsed(F.col(text)))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as windows-1252."""
    own = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}  # where it isn't Latin-1
    other = F.translate(F.decode(content, "ISO-8859-1"), "".join(k for k, v in own.items() if v), "".join(own.values()))
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(other)


@F.arrow_udf(T.StringType())
def _printed(raw: pa.Array) -> pa.Array:
    """JSON over several lines, two spaces deep; null for what isn't JSON."""
    out = []
    for x in raw.to_pylist():
        try:
            out.append(None if x is None else json.dumps(json.loads(x), ensure_ascii=False, indent=2))
        except ValueError:
            out.append(None)
    return pa.array(out, pa.string())


def json_text(raw: Column) -> Column:
    """The first string under some keys, else the printed JSON up to 50,000 code points, collapsed; an error mark for other texts."""
    printed = collapsed(F.substring(_printed(raw), 1, MOST_JSON))
    return F.coalesce(first_string(raw), printed, F.lit("_Errore: JSON non valido_"))


def rel_key(path: Column, root: str) -> Column:
    """A path below the root, and for a path outside of it the file's name."""
    clean = lambda x: F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?(?=/)", "")
    base = root.rstrip("/").removeprefix("file://") + "/"
    return F.when(F.startswith(clean(path), F.lit(base)), F.substring(clean(path), len(base) + 1, 1 << 30)).otherwise(F.element_at(F.split(path, "/"), -1))


def top_files(spark: SparkSession, folder: str, types=(".pdf", ".md", ".txt")) -> DataFrame:
    """path and name of the files of some types directly in a folder, hidden ones left out, in the order of their names."""
    files = spark.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.where(~F.startswith("name", F.lit(".")) & file_type(F.col("name")).isin(*types)).orderBy("name")


def selected(files: DataFrame, globs: list[str] | None) -> DataFrame:
    """Scanned files whose relative path fits one of some globs (* within a name, ** across folders), each once."""
    if not globs:
        return files
    fits = F.lit(False)
    for g in globs:
        pattern = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x) or re.escape(x) for x in re.findall(r"\*\*|\*|\?|[^*?]+", g.replace("**/", "**")))
        fits = fits | F.col("rel").rlike(f"^{pattern}$")
    return files.where(fits).dropDuplicates(["path"])


def code_lines(text: Column) -> Column:
    """Lines of a source text: its line ends and one; null for an empty or blank one, which is an error."""
    return F.when(F.trim(text) != "", F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)


def dump(files: DataFrame, most_bytes: int = 120_000) -> DataFrame:
    """rel and section: each file up to a size as a headed fence, to be written in the order of the paths.

    Sections stay rows: a text sink writes them in order, no task holds all files.
    """
    body = F.concat(F.lit("## "), F.col("rel"), F.lit("\n\n```\n"), decoded(F.col("content")), F.lit("\n```\n"))
    return files.where(F.col("length") <= most_bytes).select("rel", body.alias("section")).orderBy("rel")


def texts(files: DataFrame, flatten: bool = True) -> DataFrame:
    """Scanned files with text and status; types that need a missing library have status unsupported."""
    office = files.where(F.col("type") == ".docx").select("path", "rel", "type", "length", docx_text(F.col("content")).alias("text"))
    raw = files.withColumn("raw", decoded(F.col("content")))
    html = html_to_text(raw.where(F.col("type").isin(".html", ".htm")).select("path", "rel", "type", "length", F.col("raw").alias("html")))
    plain = raw.where(F.col("type").isin(*PLAIN)).select("path", "rel", "type", "length", (collapsed(F.col("raw")) if flatten else F.col("raw")).alias("text"))
    objects = raw.where(F.col("type") == ".json").select("path", "rel", "type", "length", json_text(F.col("raw")).alias("text"))
    other = raw.where(~F.col("type").isin(".html", ".htm", ".json", ".docx", *PLAIN)).select("path", "rel", "type", "length", F.lit(None).cast("string").alias("text"))
    return plain.unionByName(objects).unionByName(html.select("path", "rel", "type", "length", "text")).unionByName(office).unionByName(other).withColumn("status", validity(F.col("text"), F.col("length")))


def validity(text: Column, length: Column, most_bytes: int = MOST_BYTES) -> Column:
    """ok, or why a file isn't processed; a length of null is a file that isn't there."""
    return (
        F.when(length.isNull(), "missing").when(length == 0, "empty").when(length > most_bytes, "too_large").when(text.isNull(), "unsupported").when(collapsed(text) == "", "blank")
        .when(F.substring(text, 1, 120).contains("_Errore"), "converter_error").otherwise("ok")
    )
