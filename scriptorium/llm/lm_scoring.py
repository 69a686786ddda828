"""Stupid-backoff scores of documents under the n-gram counts of the whole corpus, as joins on hash-partitioned counts.

A document is scored by what the rest of the corpus says about it: its own occurrences are taken out of every count, so
that no text vouches for itself. For each word, the longest n-gram that the rest of the corpus holds gives
count(n-gram) / count(its first n-1 words); each length that fails costs the factor `backoff`.

1. Documents are read in slabs of half a million words. A slab asks for the corpus counts of its distinct n-grams, and
   tells how often it holds each: one packed row for each slab and range of hashes. So an n-gram is sent once by a slab,
   however common it is, and no range is hot.
2. A range of hashes sums the counts that the slabs tell, and answers each slab: the join of count table and n-grams.
3. A slab puts the answers to its words and sums the logarithms for each document.

Logarithms are rounded to millionths and summed as integers, so that results don't depend on any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, cut, q, text_of, word_array
from scriptorium.llm.hashing import U64, mixed, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Words of a slab; a longer document is a slab of its own.
SLAB = 500_000
#: Words of the corpus for each range of hashes, and the fewest ranges.
RANGE, LEAST_RANGES = 2_000_000, 64
#: n-grams are told apart by so many bits of their hashes.
BITS = 56
MICRO = 1_000_000


def squeezed(values: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def expanded(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, U64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").reshape(n)


def grams(words: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n from 1 to `order`, the hash of the n-gram that ends at each word; only where place >= n - 1 it means any."""
    found = [words]
    for n in range(2, order + 1):
        before = np.concatenate([np.zeros(1, U64), found[-1][:-1]]) if len(words) else found[-1]
        found.append(mixed(before * U64(0x9E3779B97F4A7C15) + words + U64(n)) >> U64(64 - BITS))
    return found


def places(sizes: np.ndarray) -> np.ndarray:
    """The place of each word in its document."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(slab, ids, sizes, word hashes); a slab's name depends on its place and content alone."""
    ids, words, n, number = [], [], 0, 0
    part = TaskContext.get().partitionId()

    def done() -> tuple[int, list, np.ndarray, np.ndarray]:
        sizes, all_words = np.array([len(w) for w in words], np.int64), np.concatenate(words)
        name = xxhash.xxh3_64_intdigest(all_words.tobytes() + sizes.tobytes() + f"{part}:{number}:{ids[0]}".encode())
        return name - (1 << 63), ids, sizes, all_words

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                hashes = word_hashes(text) >> U64(64 - BITS)
                if ids and n + len(hashes) > SLAB:
                    yield done()
                    ids, words, n, number = [], [], 0, number + 1
                ids.append(doc), words.append(hashes)
                n += len(hashes)
    if ids:
        yield done()


def _asked(batches: Iterator[pa.RecordBatch], order: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """For each slab and range of hashes: distinct n-grams of each length, as differences, and how often the slab has them."""
    limits = np.array([(i << BITS) // ranges for i in range(1, ranges)], U64)
    for slab, _, sizes, words in _slabs(batches):
        place = places(sizes)
        numbers, hashes, counts = [[] for _ in range(ranges)], [[] for _ in range(ranges)], [[] for _ in range(ranges)]
        for n, ends in enumerate(grams(words, place, order)):
            u, c = np.unique(ends[place >= n], return_counts=True)
            cuts = np.concatenate([[0], np.searchsorted(u, limits), [len(u)]])
            for r in range(ranges):
                own = u[cuts[r] : cuts[r + 1]]
                numbers[r].append(len(own))
                hashes[r].append(squeezed(np.diff(own, prepend=U64(0))))
                counts[r].append(squeezed(c[cuts[r] : cuts[r + 1]]))
        used = [r for r in range(ranges) if any(numbers[r])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([slab] * len(used), pa.int64()), pa.array(used, pa.int32()), *(pa.array([x[r] for r in used], pa.list_(t)) for x, t in ((numbers, pa.int32()), (hashes, pa.binary()), (counts, pa.binary())))],
            names=["slab", "range", "numbers", "hashes", "counts"],
        )


def _answered(rows: pd.DataFrame, order: int) -> pd.DataFrame:
    """One range of the count table, joined to what each slab has asked."""
    answers = [[] for _ in range(len(rows))]
    for n in range(order):
        numbers = [int(x[n]) for x in rows["numbers"]]
        asked = [np.cumsum(expanded(h[n], k), dtype=U64) for h, k in zip(rows["hashes"], numbers)]
        told = [expanded(c[n], k) for c, k in zip(rows["counts"], numbers)]
        _, at = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(told).astype(float)).astype(np.int64)[at] if len(at) else at
        for mine, part in zip(answers, np.split(total, np.cumsum(numbers)[:-1])):
            mine.append(squeezed(part))
    return pd.DataFrame({"slab": rows["slab"], "range": rows["range"], "numbers": rows["numbers"], "counts": answers})


def _kept(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each slab: ids and sizes of its documents, its distinct words, and which of them each word is."""
    for slab, ids, sizes, words in _slabs(batches):
        u, at = np.unique(words, return_inverse=True)
        columns = [pa.array([slab], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([len(u)], pa.int32()), pa.array([squeezed(np.diff(u, prepend=U64(0)))], pa.binary()), pa.array([squeezed(at)], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["slab", "ids", "sizes", "n_distinct", "distinct", "words"])


def _summed(slabs: pd.DataFrame, answers: pd.DataFrame, order: int, backoff: float, total: int) -> pd.DataFrame:
    """Scores of the documents of one slab."""
    if len(slabs) != 1 or not len(answers):
        raise RuntimeError("the documents came in another order when they were read again: checkpoint them first")
    slab, answers = slabs.iloc[0], answers.sort_values("range")
    sizes = np.array(slab["sizes"], np.int64)
    words = np.cumsum(expanded(slab["distinct"], int(slab["n_distinct"])), dtype=U64)[expanded(slab["words"], int(sizes.sum())).astype(np.int64)]
    place, doc = places(sizes), np.repeat(np.arange(len(sizes)), sizes)
    rest: list[np.ndarray] = []  # by n - 1: how often the other documents hold the n-gram that ends at each word
    for n, ends in enumerate(grams(words, place, order)):
        here = np.flatnonzero(place >= n)
        _, at = np.unique(ends[here], return_inverse=True)
        count = np.concatenate([expanded(c[n], int(k[n])) for c, k in zip(answers["counts"], answers["numbers"])]).astype(np.int64)
        _, own, often = np.unique(doc[here] * (len(count) + 1) + at, return_inverse=True, return_counts=True)
        full = np.zeros(len(words), np.int64)
        full[here] = count[at] - often[own]
        rest.append(full)
    others = total - sizes[doc]
    micro, failed, open_ = np.zeros(len(words), np.int64), np.zeros(len(words)), np.ones(len(words), bool)
    for n in range(order, 0, -1):
        tried = open_ & (place >= n - 1)
        hit = np.flatnonzero(tried & (rest[n - 1] > 0))
        base = rest[n - 2][hit - 1] if n > 1 else others[hit]
        micro[hit] = np.rint(MICRO * (failed[hit] * np.log10(backoff) + np.log10(rest[n - 1][hit] / base)))
        open_[hit] = False
        if n > 1:
            failed[tried & open_] += 1
    left = np.flatnonzero(open_)
    micro[left] = np.rint(MICRO * (failed[left] * np.log10(backoff) + np.log10(1 / (others[left] + 1))))
    sums = np.zeros(len(sizes), np.int64)
    np.add.at(sums, doc, micro)
    return pd.DataFrame({"doc_id": list(slab["ids"]), "n_words": sizes, "micro": sums})


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, score (log10 for each word) and total (their sum over the document) for each row of `docs`.

    Null, empty and blank texts have no words, no score and total 0. N-grams are told apart by 56 bits of a hash: of d
    distinct ones, some d * d / 2^57 pairs share their counts (1 in 10^8 n-grams' worth at d = 10^8, some hundreds of
    pairs at 10^10). A word that no other document holds counts as
    1 / (words of the other documents + 1). Repeated rows are documents of their own and vouch for each other. Other
    columns are not looked at; an empty table gives an empty table. Rows are read twice, in an order that has to be the
    same: files and checkpoints are, the outcome of a shuffle has to be checkpointed first (else the job fails).
    """
    rows = bounded_batches(docs).select(q(doc_id).alias("doc_id"), q(text).cast("string").alias("text"))
    id_field = rows.schema["doc_id"]
    id_type = id_field.dataType.simpleString()
    total = int(rows.agg(F.sum(F.size(word_array(text_of("text"))).cast("long")).alias("n")).first()["n"] or 0)
    ranges = max(LEAST_RANGES, -(-total // RANGE))
    asked = rows.mapInArrow(lambda b: _asked(b, order, ranges), "slab long, range int, numbers array<int>, hashes array<binary>, counts array<binary>")
    answers = asked.groupBy("range").applyInPandas(lambda x: _answered(x, order), "slab long, range int, numbers array<int>, counts array<binary>")
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_type = to_arrow_type(id_field.dataType)
    kept = rows.mapInArrow(lambda b: _kept(b, arrow_type), f"slab long, ids array<{id_type}>, sizes array<long>, n_distinct int, distinct binary, words binary")
    summed = kept.groupBy("slab").cogroup(answers.groupBy("slab")).applyInPandas(lambda a, b: _summed(a, b, order, backoff, total), f"doc_id {id_type}, n_words long, micro long")
    return summed.select("doc_id", "n_words", *_scores())


def _scores() -> list[Column]:
    return [F.when(F.col("n_words") > 0, F.round(F.col("micro") / F.col("n_words"), 0) / MICRO).alias("score"), (F.col("micro") / MICRO).alias("total")]


def score_by_rows(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What score() gives, with one row for each n-gram: counts for each document, their sums for each n-gram by hash
    partition, and a join of both with the exploded n-grams, summed for each document.

    Null, empty and repeated rows, other columns and empty tables are as score() has them.

    Plain, but it shuffles every n-gram of every document several times; score() is the same join with the n-grams of a
    slab packed into a few rows. Rows need a number, so they are written once before.
    """
    texts = docs.select(q(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    words = rows.select("row", F.posexplode(word_array(F.col("text"))).alias("i", "w"))
    before = Window.partitionBy("row").orderBy("i")
    last = words.select("row", "i", *[F.lag("w", k).over(before).alias(f"w{k}") for k in range(order)])
    grams = F.array(*[F.struct(F.lit(n).alias("n"), F.xxhash64(F.lit(n), *[f"w{k}" for k in range(n)]).alias("g")) for n in range(1, order + 1)])
    every = last.select("row", "i", F.inline(grams)).where("i >= n - 1")
    own = every.groupBy("row", "n", "g").agg(F.count("*").alias("own"))
    counts = own.groupBy("n", "g").agg(F.sum("own").alias("all"))
    rest = every.join(own.join(counts, ["n", "g"]).select("row", "n", "g", (F.col("all") - F.col("own")).alias("rest")), ["row", "n", "g"])
    places = rest.groupBy("row", "i").agg(*[F.max(F.when(F.col("n") == n, F.col("rest"))).alias(f"r{n}") for n in range(1, order + 1)])
    sizes = words.groupBy("row").agg(F.count("*").alias("n_words"))
    total = int(sizes.agg(F.sum("n_words").alias("n")).first()["n"] or 0)
    based = places.join(sizes, "row").select("*", *[F.lag(f"r{n}").over(before).alias(f"b{n}") for n in range(1, order)])
    others = F.lit(total) - F.col("n_words")
    longest = F.least(F.col("i") + 1, F.lit(order))  # the first length that is tried
    log = F.when(F.lit(False), 0.0)
    for n in range(order, 0, -1):
        base = F.col(f"b{n - 1}") if n > 1 else others
        log = log.when((F.col("i") >= n - 1) & (F.col(f"r{n}") > 0), (longest - n) * F.log10(F.lit(backoff)) + F.log10(F.col(f"r{n}") / base))
    log = log.otherwise((longest - 1) * F.log10(F.lit(backoff)) + F.log10(1 / (others + 1)))
    summed = based.select("row", F.rint(MICRO * log).cast("long").alias("micro")).groupBy("row").agg(F.sum("micro").alias("micro"), F.count("*").alias("n_words"))
    found = rows.select("row", "doc_id").join(summed, "row", "left").fillna(0, ["micro", "n_words"])
    return found.select("doc_id", "n_words", *_scores())
