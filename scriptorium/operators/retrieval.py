"""Retrieval: top hits by cosine, and packing them under a budget of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import truncated_middle
from scriptorium.operators.dedup import saved

#: Queries of one block, which is broadcast: 64 components take 2 MB.
BLOCK = 4_096
#: Candidates and queries compared in one step: scores, their ids and order take some 50 bytes for each pair.
ROWS, ASKED = 2_048, 256


def _better(best: tuple | None, names: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(names, scores) of the k best candidates of each query, from those so far and one step's more; ranked as the whole is."""
    norms = np.linalg.norm(x, axis=1)
    scores = np.where(norms[None, :] > 0, q @ x.T / np.where(norms == 0, 1, norms)[None, :], -np.inf)
    scores[own[:, None] == names[None, :]] = -np.inf
    scores[~q.any(axis=1)] = -np.inf
    ids = np.broadcast_to(names, scores.shape)
    if best is not None:
        ids, scores = np.concatenate([best[0], ids], axis=1), np.concatenate([best[1], scores], axis=1)
    order = np.lexsort((ids, -np.round(scores, 9)), axis=1)[:, :k]
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(scores, order, axis=1)


def vector_topk(table: DataFrame, is_query: Column, k: int = 12, least: float = -1.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of the highest cosine from `least` on, without the query's own.

    Queries come in blocks of a fixed size, broadcast one after another; candidates stay where they are, and a task
    hands on k rows for each query. Scores are ranked rounded to nine places, ties by the smaller id. Rows
    without id or vector, of norm 0, or with a null component take no part; vectors of another length than the query's
    are no hits of it.
    """
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    asking, last, found = rows.where(is_query), None, []
    while True:
        some = (asking if last is None else asking.where(F.col("vec_id") > last)).orderBy("vec_id").limit(BLOCK).collect()
        if not some:
            break
        last = some[-1]["vec_id"]
        by_size = {}
        for r in some:
            by_size.setdefault(len(r["v"]), []).append(r)
        asked = {n: (np.array([r["vec_id"] for r in rs]), np.array([r["v"] for r in rs], float)) for n, rs in by_size.items()}
        unit = {n: (ids, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) for n, (ids, x) in asked.items()}
        shared = table.sparkSession.sparkContext.broadcast(unit)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for batch in batches:
                sizes = np.asarray(batch.column("v").value_lengths())
                for n, (own, q) in shared.value.items():
                    fit = batch.filter(pa.array(sizes == n))
                    for at in range(0, fit.num_rows, ROWS):
                        part = fit.slice(at, ROWS)
                        names, x = np.asarray(part.column("vec_id")), part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, n)
                        for first in range(0, len(own), ASKED):
                            some = slice(first, first + ASKED)
                            best[n, first] = _better(best.get((n, first)), names, x, own[some], q[some], k)
            for (n, first), (ids, scores) in best.items():
                i, j = np.nonzero(scores >= least)
                yield pa.RecordBatch.from_arrays([pa.array(shared.value[n][0][first + i]), pa.array(ids[i, j]), pa.array(scores[i, j])], names=["query_id", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
        hits = rows.mapInArrow(run, "query_id long, vec_id long, score double").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found.append(saved(hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))))
        if len(some) < BLOCK:
            break
    if not found:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def within_budget(hits: DataFrame, key: str, order: str, size: Column, most: int, used: int = 0) -> DataFrame:
    """The leading hits of each key whose sizes fit together; the first that doesn't ends the list."""
    before = Window.partitionBy(key).orderBy(order)
    total = hits.withColumn("used", F.sum(size).over(before.rowsBetween(Window.unboundedPreceding, 0)) + used)
    return total.where(F.col("used") <= most)


def context_bundle(parts: Column, most: int, least_part: int = 2000, least_rest: int = 500) -> Column:
    """Parts (an ordered array of texts) cut to an equal share, then taken until `most`; a rest of over least_rest is cut in.

    Returns a struct of the taken texts and what became of each part: whole, cut or left out.
    """
    share = F.greatest(F.lit(least_part), F.floor(F.lit(most) / F.greatest(F.size(parts), F.lit(1))).cast("int"))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("texts"))

    def step(a: Column, x: Column) -> Column:
        half = F.floor(share / 2).cast("int")
        long = F.length(x) > share
        notice = F.concat(F.lit("\n\n_[… "), (F.length(x) - share).cast("string"), F.lit(" caratteri omessi …]_\n\n"))
        own = F.when(long, F.concat(F.substring(x, F.lit(1), half), notice, F.right(x, half))).otherwise(x)
        rest = F.lit(most) - a["total"]
        over = F.length(own) > rest
        text = F.when(over, F.substring(own, F.lit(1), rest)).otherwise(own)
        done = a["done"] | (over & (rest <= least_rest))
        return F.struct(
            F.when(done, a["total"]).otherwise(a["total"] + F.length(text)).alias("total"),
            done.alias("done"),
            F.when(done, a["texts"]).otherwise(F.array_append(a["texts"], text)).alias("texts"),
        )

    return F.aggregate(parts, start, step, lambda a: F.struct(a["texts"].alias("texts"), a["total"].alias("total"), a["done"].alias("cut_off")))


def canon_bundle(canon: DataFrame, most: int, least_part: int = 2000, least_rest: int = 500) -> str:
    """The canon's parts (tier, rel, text) as one text of `most` code points and heads: each is cut in its middle to an equal
    share, parts are taken in order of tier and lower(rel) while they fit, and a rest of over least_rest is cut in.

    Files without text are left out and count in no share. What is taken is at most `most` parts of at most a share each,
    so only these come together, whatever the canon's size.
    """
    filled = canon.where(F.length("text") > 0).select("tier", "rel", "text")
    share = max(least_part, most // max(filled.count(), 1))
    order = ["tier", F.lower("rel"), "rel"]
    first = filled.withColumn("text", truncated_middle(F.col("text"), share, F.col("rel"))).orderBy(*order).limit(most + 1)
    before = F.coalesce(F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = first.withColumn("rest", most - before).where((F.col("rest") >= F.length("text")) | (F.col("rest") > least_rest))
    block = F.concat(F.lit("### SOT: "), F.col("rel"), F.lit("\n\n"), F.substring("text", F.lit(1), F.greatest("rest", F.lit(0)).cast("int")))
    # a part after the first that didn't fit whole has no rest
    joined = taken.where("rest > 0").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", F.lower("rel").alias("low"), "rel", block.alias("block")))), lambda x: x["block"]), "\n\n---\n\n").alias("text")).first()["text"]
    return joined or "_Nessun documento SOT caricato._"


def document_keys(rows: DataFrame, fields: list[Column]) -> DataFrame:
    """Distinct keys by which a store knows its documents: each filled field, and the last part of it."""
    clean = F.transform(F.array(*[f.cast("string") for f in fields]), lambda x: F.replace(x, F.lit("\\"), F.lit("/")))
    last = lambda x: F.element_at(F.split(F.regexp_replace(x, r"(/\.?)+$", ""), "/"), -1)
    filled = F.filter(clean, lambda x: x != "")
    return rows.select(F.explode(F.array_union(filled, F.transform(filled, last))).alias("key")).distinct()


def rag_context(hits: DataFrame, key: str, order: str, most: int, head: str = "## Contesto RAG\n") -> DataFrame:
    """key and context of ranked hits (title, score, text): blocks under a head until the next doesn't fit, and then a note of
    how many were left out. Hits are the few rows of one query that a search with a fixed k gives."""
    w = Window.partitionBy(key).orderBy(order)
    score = F.coalesce(F.concat(F.lit(" (score="), F.format_string("%.3f", "score"), F.lit(")")), F.lit(""))
    block = F.concat(F.lit("### RAG "), F.col("_n").cast("string"), F.lit(": "), F.coalesce("title", F.concat(F.lit("chunk-"), F.col("_n").cast("string"))), score, F.lit("\n\n"), F.trim(F.coalesce("text", F.lit(""))), F.lit("\n"))
    rows = hits.withColumn("_n", F.row_number().over(w)).withColumn("_block", block)
    used = F.sum(F.length("_block")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + len(head)
    lists = rows.withColumn("_used", used).groupBy(key).agg(F.count("*").alias("_all"), F.array_sort(F.collect_list(F.when(F.col("_used") <= most, F.struct("_n", "_block")))).alias("_xs"))
    left = F.col("_all") - F.size("_xs")
    note = F.when(left > 0, F.array(F.concat(F.lit("_… altri "), left.cast("string"), F.lit(f" chunk RAG omessi (budget {most} char)_\n")))).otherwise(F.array().cast("array<string>"))
    return lists.select(key, F.array_join(F.concat(F.array(F.lit(head)), F.transform("_xs", lambda x: x["_block"]), note), "\n").alias("context"))


#: Where a document's place stands, and how deep listings are walked.
PLACES, MOST_DEPTH = ["location", "docpath", "path", "id"], 6


def listed_documents(rows: DataFrame, raw: str, key: str) -> DataFrame:
    """key, location and title of each document in a nested JSON listing, at most six levels down, each location once.

    Levels are opened one after another, each by one explode of the variant's children; what names a place is a document.
    """
    level = rows.select(key, F.try_parse_json(raw).alias("v")).where("v is not null")
    found = None
    for _ in range(MOST_DEPTH + 1):
        place = F.coalesce(*[F.try_variant_get("v", f"$.{k}", "string") for k in PLACES])
        docs = level.select(key, place.alias("location"), F.try_variant_get("v", "$.title", "string").alias("title")).where("location is not null")
        found = docs if found is None else found.unionByName(docs)
        level = level.select(key, F.explode(_children("v")).alias("v")).where("v is not null")
    return found.groupBy(key, "location").agg(F.min("title").alias("title"))


def _children(name: str) -> Column:
    """The objects and arrays inside of a variant."""
    items = F.try_variant_get(name, "$", "array<variant>")
    cells = F.map_values(F.try_variant_get(name, "$", "map<string,variant>"))
    nested = lambda xs: F.filter(xs, lambda x: F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"))
    return F.coalesce(nested(items), nested(cells))


def answers(table: DataFrame) -> bool:
    """Whether a search gives any hit; one row is looked for."""
    return not table.isEmpty()
