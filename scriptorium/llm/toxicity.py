"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled rows, spread by a hash of their ids. Its document counts for each hashed
n-gram and class are summed on the executors; features with a telling ratio are kept, and a logistic regression over
the scaled features is fitted on the driver, where it needs memory in proportion to the sample's bound. Scoring reads
each text once, shuffles nothing, and the model's size is bounded by its parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_batches, cut, held_out, packed, q, unpacked
from scriptorium.llm.linear import fit_logistic

#: Labelled rows that training reads at most; the bound of the sample, whatever the corpus.
TRAINING_ROWS = 20_000
#: Lengths of the n-grams, and bits of their hashes.
GRAMS, BITS = (3, 4, 5), 20
#: Features: those of the largest |log-count ratio| that at least so many training texts hold.
FEATURES, LEAST_TEXTS = 40_000, 3
THRESHOLD = 0.3
#: Code points worked on at once, texts taken out of a batch at once, and tasks over the bounded sample.
STEP, TEXTS, TASKS = 400_000, 128, 8

_BLANKS = re.compile(r"\s+")


def gram_ids(text: str | None, grams: tuple[int, ...] = GRAMS, bits: int = BITS) -> Iterator[np.ndarray]:
    """Hashes of the character n-grams of a text in lower case, white space as one space, in steps of a bounded size."""
    plain = " " + _BLANKS.sub(" ", (text or "").lower()).strip() + " "
    longest = max(grams)
    for at in range(0, len(plain), STEP):
        points = np.frombuffer(plain[at : at + STEP + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        state = np.zeros(len(points), np.uint64)
        for n in range(1, longest + 1):
            if len(points) < n:
                break
            state = state[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n == 1)
            if n in grams:
                mixed = (state ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                yield (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _packed(places: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Ascending places, and their differences, compressed."""
    return places, pa.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes(), codec="zstd", asbytes=True) if len(places) else b""


def _unpacked(data: bytes, n: int) -> np.ndarray:
    """Ascending places, in 16 bits where they fit."""
    places = np.cumsum(np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint32), dtype=np.uint32) if n else np.empty(0, np.uint32)
    return places.astype(np.uint16) if not n or places[-1] < 1 << 16 else places


@dataclass
class Model:
    """Weights by hashed n-gram (those of no feature are 0), the intercept, and how n-grams are made."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float
    grams: tuple[int, ...] = GRAMS
    bits: int = BITS

    def scorer(self) -> Callable[[str | None], float]:
        table = np.full(1 << self.bits, -1, np.int32)
        table[self.ids] = np.arange(len(self.ids), dtype=np.int32)

        def score(text: str | None) -> float:
            places = [p[p >= 0] for p in (table[g] for g in gram_ids(text, self.grams, self.bits))]
            here = np.unique(np.concatenate(places)) if places else np.empty(0, np.int32)
            return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[here].sum(), -50, 50))))

        return score


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = TRAINING_ROWS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(text, label) of at most `most` labelled rows, never of held-out ones.

    Of several labels of one id the largest counts, of several rows of one id the least text, found on the map side
    first; null labels and ids are left out. The ids are chosen by their hash and broadcast, `most` of them at most; the
    documents are filtered where they lie, by all tasks.
    """
    known = labels.where(q(label).isNotNull() & q("doc_id").isNotNull() & ~held_out(q("doc_id"))).groupBy(q("doc_id").alias("known")).agg(F.max(q(label)).cast("double").alias("label"))
    chosen = known.orderBy(F.xxhash64("known"), "known").limit(most)
    texts = docs.select(q(doc_id).alias("id"), q(text).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("known"))
    return found.groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def _texts(column: pa.Array) -> Iterator[str | None]:
    """The texts of a column of a batch, a few at a time as Python strings."""
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAINING_ROWS, grams: tuple[int, ...] = GRAMS, bits: int = BITS, features: int = FEATURES) -> Model:
    """The model learnt from the labelled rows of `docs` that aren't held out; without any, it scores all texts alike.

    The sample is written to the checkpoint folder once, `most` rows at most, and read by a few tasks from there; null
    texts count as empty. Of the sample, the driver gets one compressed vector of feature places for each row.
    """
    spark = docs.sparkSession
    rows = bounded_batches(cut(training_rows(docs, labels, label, most))).coalesce(TASKS)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros((2, 1 << bits), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for text, mark in zip(_texts(batch.column(0)), batch.column(1).to_pylist()):
                found = list(gram_ids(text, grams, bits))
                totals[int(mark > 0)] += 1
                if found:
                    counts[int(mark > 0), np.unique(np.concatenate(found))] += 1
        if totals.any():
            for at in range(0, 1 << bits, 1 << 14):
                part = counts[:, at : at + (1 << 14)]
                yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int64()), "clean": [part[0].tolist()], "marked": [part[1].tolist()], "n_clean": [int(totals[0]) if not at else 0], "n_marked": [int(totals[1]) if not at else 0]}, schema=schema)

    schema = pa.schema([("at", pa.int64()), ("clean", pa.list_(pa.int32())), ("marked", pa.list_(pa.int32())), ("n_clean", pa.int64()), ("n_marked", pa.int64())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        totals = np.zeros(2, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                parts[r["at"]] = parts.get(r["at"], 0) + np.array([r["clean"], r["marked"]])
                totals += (r["n_clean"], r["n_marked"])
        for at, both in parts.items():
            known = np.flatnonzero(both.sum(axis=0) >= LEAST_TEXTS)
            yield pa.RecordBatch.from_pydict({"ids": [(known + at).tolist()], "clean": [both[0, known].tolist()], "marked": [both[1, known].tolist()], "n_clean": [int(totals[0])], "n_marked": [int(totals[1])]}, schema=sums)
            totals[:] = 0

    sums = pa.schema([("ids", pa.list_(pa.int64())), ("clean", pa.list_(pa.int64())), ("marked", pa.list_(pa.int64())), ("n_clean", pa.int64()), ("n_marked", pa.int64())])
    partial = rows.mapInArrow(counted, "at long, clean array<int>, marked array<int>, n_clean long, n_marked long")
    total = partial.repartition(TASKS, "at").mapInArrow(summed, "ids array<long>, clean array<long>, marked array<long>, n_clean long, n_marked long").collect()
    n = np.array([sum(r["n_clean"] for r in total), sum(r["n_marked"] for r in total)], float)
    if not n.all():
        rate = float((n[1] + 1) / (n.sum() + 2))
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(rate / (1 - rate))), grams, bits)
    ids, clean, marked = (np.concatenate([np.array(r[k], np.int64) for r in total]) for k in ("ids", "clean", "marked"))
    ratio = np.log((marked + 1) / (n[1] + 2)) - np.log((clean + 1) / (n[0] + 2))
    order = np.lexsort((ids, -np.abs(ratio) * np.sqrt(marked + clean)))[:features]
    order = order[np.argsort(ids[order])]
    ids, ratio = ids[order], ratio[order]

    shared = spark.sparkContext.broadcast(ids)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << bits, -1, np.int32)
        table[shared.value] = np.arange(len(shared.value), dtype=np.int32)
        for batch in batches:
            found = []
            for text in _texts(batch.column(0)):
                places = [p[p >= 0] for p in (table[g] for g in gram_ids(text, grams, bits))]
                found.append(_packed(np.unique(np.concatenate(places)) if places else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary()), batch.column(1)], names=["n", "at", "label"])

    data = rows.mapInArrow(vectors, "n int, at binary, label double").toArrow()
    marks, sizes, places = data["label"].to_numpy() > 0, data["n"].to_numpy(), data["at"].to_pylist()
    del data
    order = sorted(range(len(places)), key=lambda i: (marks[i], sizes[i], places[i]))  # sums of floats don't depend on the order of tasks
    weights, intercept = fit_logistic((_unpacked(places[i], int(sizes[i])) for i in order), marks[order].astype(float), ratio)
    return Model(ids, weights * ratio, intercept, grams, bits)


def scores(model: Model, spark: SparkSession, text: Column) -> Column:
    """The score of each text, from 0 to 1; null and empty texts get that of an empty text.

    Only texts go to the workers and only numbers come back, so a row's other columns never leave the executor's JVM.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = shared.value.scorer()
        for batch in batches:
            yield pa.array(map(of, _texts(batch)), pa.float64())

    return run.asNondeterministic()(text.cast("string"))  # so that no plan runs it twice


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`row` (the whole input row as a struct, whatever its columns' names) and its score, for each row of `docs`.

    Null texts count as empty; very long ones are read whole, in steps; repeated rows get equal scores; an empty table
    gives an empty table. Nothing is shuffled.
    """
    rows = packed(bounded_batches(docs))
    return rows.select("row", scores(model, docs.sparkSession, F.col("row").getField(text)).alias("score"))


def scored_ids(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of `docs`, with a model learnt from `labels`.

    Rows of one id, and rows without an id (never held out), are scored one by one; other columns aren't looked at; an
    empty table gives an empty table; without any usable label all texts get one score.
    """
    slim = docs.select("doc_id", "text")
    found = score(slim, train(docs, labels)).select(F.col("row.doc_id").alias("doc_id"), "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs`, in their own columns, that aren't predicted toxic.

    Null and empty texts stay or go with the score of an empty text; repeated rows stay or go together, whatever their
    ids; further columns, of whatever name, stay as they are; an empty table gives an empty table.
    """
    found = score(docs, model or train(docs, labels))
    return found.where(F.col("score") < THRESHOLD).select(*unpacked(docs, docs.columns))
