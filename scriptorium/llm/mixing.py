"""Mixing sources to target weights with built-in functions only.

Sizes are summed for each source, targets follow from the weights by filling up to each source's limit, and every
document is emitted floor(rate) times plus one copy with the probability of the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, packed, ranked, small, unpacked, word_array

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: All sources together take this share of all sizes.
SHARE = 1.5
#: No source takes more than this many times its size.
LIMIT = 2
SEED = "mix"
#: Sources up to this number are broadcast to the documents (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Words of the whole text; null: 0."""
    return F.size(word_array(F.coalesce(text.cast("string"), F.lit("")))).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to below 1 that depends on the id alone: 32 bits of a digest. Null ids draw as the text 'null'."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":" + seed))), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size) with the column target.

    Targets share `share` of all sizes by weight; none exceeds `limit` times its size, and what it would take beyond is
    shared again by weight among the others until none is above. Each round is one sum over the sources that still
    share, so that any number of sources may come; a round in which none is above ends it.
    """
    ranks = ranked(sizes, F.col("source").asc_nulls_last())
    rows = cut(ranks.select("source", "source_size", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).alias("weight")))
    limit_of = F.col("source_size") * F.lit(float(limit))
    total = rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, full = 0.0, F.lit(False)
    while True:
        state = rows.agg(F.sum(F.when(full, limit_of)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count_if(full).alias("n_full")).first()
        if not state["weight"]:
            break
        level = (share * total - (state["taken"] or 0.0)) / state["weight"]
        above = limit_of <= F.col("weight") * F.lit(level)
        if rows.where(above).count() <= state["n_full"]:
            break
        full = above
    return rows.select("source", "source_size", F.when(full, limit_of).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def plan(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT, seed: str = SEED, most_broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """`row` (the whole input row as a struct), size, source_size, target and copies for each row of `docs`.

    A null source is a source of its own, the last one; null and empty texts have size 0 and are never emitted; rows
    with equal ids draw alike; an empty table gives an empty table. Sizes are summed on the map side before they are
    shuffled, so one hot source is one row of each task.
    """
    rows = packed(docs)
    sized = rows.select("row", F.col("row").getField(source).cast("string").alias("source"), size_of(F.col("row").getField(text)).alias("size"))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, weights, share, limit).withColumnRenamed("source", "of")
    joined = sized.join(small(goal, most_broadcast), sized["source"].eqNullSafe(goal["of"]))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (draw(F.col("row").getField(doc_id), seed) < F.col("rate") - F.floor("rate")).cast("int")
    copies = F.when(F.col("size") > 0, F.floor("rate").cast("int") + extra).otherwise(0)
    return joined.withColumn("rate", rate).select("row", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` in their own columns, each as often as the mix takes it.

    Texts that are null or without words have no size and are never taken, a null source is a source, rows of one id draw
    alike, an empty table gives an empty table, and columns of any name stay the caller's."""
    taken = plan(docs, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*unpacked(docs, docs.columns))
