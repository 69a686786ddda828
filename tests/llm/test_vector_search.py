import math

import numpy as np
from pyspark.sql import functions as F

from scriptorium.llm import vector_search


def brute(rows, is_query, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in good:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)}
    return out


def fixture():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 12)) * 0.3
    rows = [(i, (centers[i % 6] * (1 + i % 3) + rng.normal(size=12) * 0.02).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one very common vector
    return rows + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (None, [0.5] * 12), (2004, []), (2005, [0.1, 0.2]), (2006, [0.0] * 12)]


def test_top_k_matches_brute_force(spark):
    rows = fixture()
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, distances string").repartition(5)
    index = vector_search.pivot_table(table).checkpoint()
    for block in (4096, 7):
        found = vector_search.search(index, F.col("vec_id") % 50 == 0, block=block)
        assert {tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, lambda i: i % 50 == 0)


def test_fewer_rows_than_k_and_empty_tables(spark):
    rows = [(0, [1.0, -0.3]), (100, [0.5, 0.25]), (3, [0.1, 0.1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_search.search(vector_search.pivot_table(table), F.col("vec_id") % 100 == 0)
    assert found.count() == 4
    empty = vector_search.pivot_table(table.limit(0))
    assert vector_search.search(empty, F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_leave_candidates_out(monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(40, 8)) * 2000
    matrix = (centers[np.arange(4000) % 40] + rng.normal(size=(4000, 8)) * 10).astype(np.int64)
    vectors = list(matrix.astype(float))
    pivots = vector_search.far_apart(vectors[:500], 32)
    far = vector_search._distances(vectors, pivots)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"vec_id": pa.array(range(4000), pa.int64()), "vector": [x.tobytes() for x in vectors], "distances": [x.tobytes() for x in far]})
    seen = []
    add = vector_search._Best.add
    monkeypatch.setattr(vector_search._Best, "add", lambda self, i, s, ids: (seen.append(len(ids)), add(self, i, s, ids))[1])
    out = list(vector_search._searched([batch], (np.arange(5), vectors[:5], far[:5]), 10))
    assert sum(seen) < 5 * 4000 / 4
    for i, b in enumerate(out):
        scores = matrix @ matrix[i]
        scores[i] = np.iinfo(np.int64).min
        assert sorted(b.column("score").to_pylist(), reverse=True) == sorted(scores.tolist(), reverse=True)[:10]


def test_components_of_any_size_and_vectors_of_any_length(spark):
    rows = [(0, [1.0]), (1, [200000.0]), (2, [300000.0]), (100, [3e9, -7.5]), (4, [2.0**60, 1.0, 0.1]), (5, [-(2.0**61), 3.0]), (6, [1e200, 1.0]), (7, [1e200, 2.0]), (8, [1e-3] * 5000), (200, [0.25] * 5000 + [9.0]), (9, []), (10, [1e306])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = vector_search.search(vector_search.pivot_table(table), F.col("vec_id") % 100 == 0)
    longs = {(i, r, j, min(max(s, -(2**63)), 2**63 - 1)) for i, r, j, s in brute(rows[:-1], lambda i: i % 100 == 0)}  # 1024 * 1e306 is no double
    assert {tuple(r) for r in found.collect()} == longs


def test_inner_products_and_their_order_are_exact():
    x = np.array([[2.0**40, 1.0], [2.0**80, -3.0], [0.0, 5.0]])
    for y in ([3.0, 1.0], [2.0**31, 7.0], [2.0**90, 1.0]):
        assert [int(s) for s in vector_search.inner_products(x, np.array(y))] == [int(a) * int(y[0]) + int(b) * int(y[1]) for a, b in x]
    numbers = [0, 1, -1, 255, 256, -255, -256, 10**30, -(10**30), 2**63, -(2**63)]
    assert sorted(numbers) == sorted(numbers, key=vector_search.order_key)
