"""Exact top-k search by inner product, with a table of distances to pivots that rules candidates out.

Components become whole numbers of any size, and scores are exact. For vectors x and q, 2 x·q = |x|² + |q|² - |x - q|², and each pivot
p gives |x - q| >= | |x - p| - |q - p| |; the largest of these lower bounds gives an upper bound of the score. A task
takes its candidates in the order of their bounds and stops as soon as the next bound is below the query's k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, q

SCALE = 1024
K = 10
#: Pivots, and the rows of the sample (the first by a hash of their ids) among which they are chosen far apart.
PIVOTS, SAMPLE = 32, 1_024
#: Queries in hand at once: the block that is broadcast, of some 400 bytes for each query of 64 components.
BLOCK = 4_096
#: Candidates and queries compared in one step, and candidates evaluated before each look at the bound.
ROWS, COLUMNS, AHEAD = 8_192, 128, 48
#: Relative slack of the bounds, above the rounding of 32-bit distances.
SLACK = 2e-6
LEAST_LONG, MOST_LONG = -(1 << 63), (1 << 63) - 1


def _vectors(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, vectors) of rows with an id and a vector of finite components, in steps; components are whole numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4_096):
            part = batch.slice(at, 4_096)
            lists = part.column(1).cast(pa.list_(pa.float64()))
            sizes = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            with np.errstate(over="ignore"):
                flat = np.floor(scale * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float))  # null components become nan
            good = np.asarray(lists.is_valid()) & np.asarray(part.column(0).is_valid())
            good[np.repeat(np.arange(len(sizes)), sizes)[~np.isfinite(flat)]] = False
            if good.any():
                ends = np.cumsum(sizes)
                yield part.column(0).filter(pa.array(good)), [flat[e - n : e] for e, n in zip(ends[good], sizes[good])]


def _by_length(vectors: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length, so that a long one doesn't pad the others."""
    sizes = np.array([len(v) for v in vectors], np.int64)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, np.array([vectors[i] for i in at]).reshape(len(at), n)


def _distances(vectors: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Distances of all vectors to all pivots; a shorter vector ends in zeros."""
    out = np.zeros((len(vectors), len(pivots)), np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.array([(p**2).sum() for p in pivots])
        for at, x in _by_length(vectors):
            inner = np.zeros((len(at), len(pivots)))
            for j, p in enumerate(pivots):
                m = min(len(p), x.shape[1])
                inner[:, j] = x[:, :m] @ p[:m]
            out[at] = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + norms[None, :] - 2 * inner, 0))
    return out


def far_apart(sample: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Up to n vectors of the sample, each the farthest from those before it."""
    if not sample:
        return []
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while True:
        nearest = np.fmin(nearest, _distances(sample, [sample[chosen[-1]]])[:, 0])
        if len(chosen) == n or not nearest.max() > 0:
            return [sample[i] for i in chosen]
        chosen.append(int(nearest.argmax()))


def pivot_table(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector as 64-bit floats that are whole numbers, distances to all pivots as 32-bit floats) of every usable row.

    Rows without an id, with a null vector, or with a null or non-finite component (or one whose 1024-fold is beyond the
    range of doubles) are left out; an empty vector is one of zeros, and so ends a vector shorter than another. Only the
    pivots' sample, of a fixed number of rows, passes through the driver.
    """
    slim = rows.select(q(vec_id).cast("long").alias("vec_id"), q(vector).cast("array<double>").alias("v"))

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _vectors(batches, scale):
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in vectors], pa.binary())], names=["vec_id", "vector"])

    schema = "vec_id long, vector binary"
    first = slim.mapInArrow(plain, schema).orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(SAMPLE).collect()
    chosen = far_apart([np.frombuffer(r["vector"], float) for r in first], pivots)

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _vectors(batches, scale):
            far = _distances(vectors, chosen)
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes() for x in vectors], pa.binary()), pa.array([x.tobytes() for x in far], pa.binary())], names=["vec_id", "vector", "distances"])

    return slim.mapInArrow(described, schema + ", distances binary")


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of x with y, all whole numbers: 64-bit where they surely fit, else of any size."""
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * max(1, len(y))
    if bound < 2**53:
        return (x @ y).astype(np.int64)
    if bound < 2**62 and np.abs(x).max() < 2**62 and np.abs(y).max() < 2**62:
        return x.astype(np.int64) @ y.astype(np.int64)
    right = [int(b) for b in y]
    return np.array([sum(int(a) * b for a, b in zip(row, right)) for row in x], object)


def order_key(score: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    n = abs(int(score))
    size = (n.bit_length() + 7) // 8
    head = size.to_bytes(4, "big") + n.to_bytes(size, "big")
    return b"\1" + head if score >= 0 else b"\0" + bytes(255 - x for x in head)


class _Best:
    """The k best (score, id) of each query of a block, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        self.least = np.full(n, -np.inf)
        self.evaluated = 0

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        self.evaluated += len(ids)
        scores, ids = np.concatenate([self.scores[i], scores]), np.concatenate([self.ids[i], ids])
        if scores.dtype == object:
            best = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[: self.k]
        else:
            best = np.lexsort((ids, -scores))[: self.k]
        self.scores[i], self.ids[i] = scores[best], ids[best]
        if len(best) == self.k:
            last = int(scores[best[-1]])
            self.least[i] = float(last) if abs(last) < 1 << 1000 else -np.inf


def _step(best: _Best, asked: tuple, at: np.ndarray, wanted: np.ndarray, ids: np.ndarray, x: np.ndarray, distances: np.ndarray) -> None:
    """Candidates x against the queries `at` (their vectors in `wanted`), each in the order of the candidates' bounds."""
    own, far = asked
    m = min(wanted.shape[1], x.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        lower = np.zeros((len(at), len(ids)), np.float32)
        for p in range(distances.shape[1]):
            np.fmax(lower, np.abs(far[at, p, None] - distances[None, :, p]), out=lower)
        total = (wanted**2).sum(axis=1)[:, None] + (x**2).sum(axis=1)[None, :]
        rounding = far[at].max(axis=1, initial=0)[:, None].astype(float) + distances.max(axis=1, initial=0)[None, :]
        lower = np.maximum(lower - SLACK * (np.sqrt(2 * total) + rounding) - 1e-3, 0)
        upper = (total - lower**2) / 2 * (1 + 1e-12) + 1e-6 + SLACK * total
    upper[~np.isfinite(upper)] = np.inf  # too large to be bounded: looked at
    for i, query, bound in zip(at, wanted, upper):
        left = np.flatnonzero((bound >= best.least[i]) & (ids != own[i]))
        left = left[np.argsort(-bound[left], kind="stable")]
        for a in range(0, len(left), AHEAD):
            if bound[left[a]] < best.least[i]:
                break
            now = left[a : a + AHEAD]
            best.add(i, inner_products(x[now, :m], query[:m]), ids[now])


def _searched(batches: Iterator[pa.RecordBatch], block: tuple, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of one partition's candidates for each query of the block."""
    own, vectors, far = block
    best, queries = _Best(len(own), k), list(_by_length(vectors))
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            ids = np.asarray(part.column("vec_id"))
            distances = np.frombuffer(b"".join(part.column("distances").to_pylist()), np.float32).reshape(len(ids), -1)
            for some, x in _by_length([np.frombuffer(v, float) for v in part.column("vector").to_pylist()]):
                for at, wanted in queries:
                    for c in range(0, len(at), COLUMNS):
                        _step(best, (own, far), at[c : c + COLUMNS], wanted[c : c + COLUMNS], ids[some], x, distances[some])
    for i, mine in enumerate(own):
        if len(n := best.ids[i]):
            exact = [int(s) for s in best.scores[i]]
            columns = [pa.array([mine] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array([min(max(s, LEAST_LONG), MOST_LONG) for s in exact], pa.int64()), pa.array([order_key(s) for s in exact], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "exact"])


def search(table: DataFrame, is_query: Column, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k highest scores of each query among all rows with other ids.

    `table` is a pivot table, best written before; its rows where `is_query` holds ask. Fewer rows than k give all of
    them; ties go to the smaller id; of rows with one id, all are candidates and the one of the least vector asks.
    Queries go in blocks of a fixed size, each broadcast to all candidates, which stay where they are; a task hands on k
    rows for each query at most. Ranks follow the exact scores; a score beyond 64 bits is given as the nearest long. An empty
    table, or one where nothing asks, gives an empty table.
    """
    spark = table.sparkSession
    asking = cut(table.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vector", "distances")).alias("x")).select("vec_id", "x.vector", "x.distances"))
    found, last = [], None
    while True:
        rows = (asking if last is None else asking.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).collect()
        if not rows:
            break
        last = rows[-1]["vec_id"]
        ids = np.array([r["vec_id"] for r in rows], np.int64)
        asked = [np.frombuffer(r["vector"], float) for r in rows]
        shared = spark.sparkContext.broadcast((ids, asked, np.array([np.frombuffer(r["distances"], np.float32) for r in rows])))
        some = table.mapInArrow(lambda b, shared=shared: _searched(b, shared.value, k), "query_id long, vec_id long, score long, exact binary")
        order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
        some = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if len(rows) < block:
            found.append(some)
            break
        found.append(cut(some))
        shared.unpersist()
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result
