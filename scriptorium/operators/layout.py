"""Pages from a table of blocks: reading order, image numbers, the image that a box shows, and the need of character recognition.

Blocks and images are rows that any extractor can give: (doc, page, x0, y0, x1, y1, ...). No PDF library is needed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points below which a page has too little text, and bytes of content from which it shows something.
LEAST_CHARS, LEAST_BYTES = 50, 4096
MARK = "[IMG_REF:"
#: Stands below and right of every box.
LAST = 1e300
#: Blocks that a task puts in order, on average; documents stay whole.
BLOCKS = 250_000


def shown_image(blocks: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """Image blocks (keys, block, x0, y0, x1, y1) with the xref of the image (keys, ord, xref, x0, y0, x1, y1) that covers
    the largest part of their box; of equal parts the first by ord; null if none does. A page's boxes meet in one join."""
    i = images.select(*keys, "ord", "xref", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    width = F.least("x1", "_x1") - F.greatest("x0", "_x0")
    height = F.least("y1", "_y1") - F.greatest("y0", "_y0")
    common = blocks.join(i, keys).where((width > 0) & (height > 0)).groupBy(*keys, "block").agg(F.min_by("xref", F.struct((-(width * height)).alias("a"), F.col("ord"))).alias("xref"))
    return blocks.join(common, [*keys, "block"], "left")


def spread(blocks: DataFrame, doc: str = "doc") -> DataFrame:
    """Rows dealt out by document to so many tasks that a task's share doesn't grow with the table."""
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(max(tasks, -(-blocks.count() // BLOCKS)), doc)


def numbered_pages(blocks: DataFrame, doc: str = "doc", page: str = "page", dealt_out: bool = False) -> DataFrame:
    """doc, page and body: blocks (block, x0, y0, kind text or image, text, xref) in reading order, images as numbered marks.

    An image without an xref has a number of its own, one with an xref keeps its first number on the page; numbers go on
    from page to page. All is ordered inside documents, so rows are shuffled once, by document; not at all if they are dealt out so.
    """
    blocks = blocks if dealt_out else spread(blocks, doc)
    reading = [F.round("y0", 2), F.round("x0", 2), F.col("block")]
    rows = blocks.withColumn("_place", F.row_number().over(Window.partitionBy(doc, page).orderBy(*reading)))
    is_image = F.col("kind") == "image"
    first = F.row_number().over(Window.partitionBy(doc, page, "kind", "xref").orderBy("_place")) == 1
    rows = rows.withColumn("_new", (is_image & (F.col("xref").isNull() | first)).cast("int"))
    rows = rows.withColumn("_n", F.sum("_new").over(Window.partitionBy(doc).orderBy(page, "_place").rowsBetween(Window.unboundedPreceding, 0)))
    number = F.when(F.col("xref").isNull(), F.col("_n")).otherwise(F.min("_n").over(Window.partitionBy(doc, page, "kind", "xref")))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")
    part = F.when(is_image, F.concat(F.lit(MARK), F.format_string("img_%03d", number), F.lit("]"))).otherwise(F.nullif(text, F.lit("")))
    lists = rows.withColumn("_part", part).groupBy(doc, page).agg(F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("_place", "_part")))).alias("_xs"))
    return lists.select(doc, page, F.array_join(F.transform("_xs", lambda x: x["_part"]), "\n\n").alias("body"))


def with_unreferenced(blocks: DataFrame, images: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Blocks as numbered_pages takes them, and behind a page's last one a block for each image placed on it (doc, page, ord, xref)
    that none of its blocks shows, once each, in order of ord. Pages without blocks get theirs too.

    Blocks and images are dealt out together, by document, and an image's rows are compared where they are: nothing is joined,
    and pages are numbered in the same tasks."""
    double = {"y0": F.col("y0").cast("double"), "x0": F.col("x0").cast("double")}
    own = {doc: F.col(doc), page: F.col(page), "block": F.col("ord"), "y0": F.lit(LAST), "x0": F.lit(LAST), "kind": F.lit("image"), "xref": F.col("xref")}
    wanted = blocks.withColumns(double)
    more = images.where("xref is not null").select(*[(own[c] if c in own else F.lit(None)).cast(wanted.schema[c].dataType).alias(c) for c in blocks.columns], F.lit(True).alias("_placed"))
    rows = spread(wanted.withColumn("_placed", F.lit(False)).unionByName(more), doc)
    shows = F.col("kind").eqNullSafe("image") & F.col("xref").isNotNull()
    each = Window.partitionBy(doc, page, F.when(shows, F.col("xref")), F.when(~shows, F.col("block")))
    first = F.row_number().over(each.orderBy("_placed", "block")) == 1
    return rows.withColumn("_first", first).where(~F.col("_placed") | F.col("_first")).drop("_first", "_placed")


def with_recognised(pages: DataFrame, recognised: DataFrame, doc: str = "doc", page: str = "page") -> DataFrame:
    """Pages (doc, page, body) with the text that character recognition has found (doc, page, text) behind their own; blank finds change nothing."""
    strip = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    found = recognised.where(strip(F.col("text")) != "").groupBy(doc, page).agg(F.max("text").alias("_more"))
    own = strip(F.col("body"))
    body = F.when(F.col("_more").isNull(), F.col("body")).when(own == "", F.col("_more")).otherwise(F.concat(own, F.lit("\n\n"), F.col("_more")))
    return pages.join(found, [doc, page], "left").select(*[body.alias("body") if c == "body" else F.col(c) for c in pages.columns])


def needs_recognition(chars: Column, has_images: Column, content_bytes: Column) -> Column:
    """Whether a page with little text of its own shows something that may be text."""
    return (chars < LEAST_CHARS) & (has_images | (content_bytes >= LEAST_BYTES))


def assembled(pages: DataFrame, name: Column, doc: str = "doc", page: str = "page", by: str = "PyMuPDF") -> DataFrame:
    """doc and text: a head with the file's name, then the pages in their order, or a note where no page has text."""
    lists = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.when(F.col("body").isNotNull(), F.struct(page, "body")))).alias("_xs"))
    head = F.concat(F.lit("# Raw extraction — "), name, F.lit(f"\n\n> V2 physical extract ({by}). Placeholder immagini: `[IMG_REF:img_NNN]`\n\n"))
    body = F.concat(F.array_join(F.transform("_xs", lambda x: x["body"]), "\n\n"), F.lit("\n"))
    return lists.select(doc, F.concat(head, F.when(F.size("_xs") == 0, F.lit("_(nessun testo estratto — possibile PDF raster; installare Tesseract per OCR)_\n")).otherwise(body)).alias("text"))


def plain_extract(name: Column, text: Column) -> Column:
    """A plain text as a raw extract of one page."""
    return F.concat(F.lit("# Raw extraction — "), name, F.lit("\n\n> V2 text intake (no PDF). Source: `"), name, F.lit("`\n\n## Page 1\n\n"), F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n"))
