import math

import numpy as np
import pytest

from scriptorium.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def plain_version(rows, threshold=0.95):
    """Links by all pairs, components by searching from each row; rows are told apart by their place."""
    def usable(r):
        v = r[1]
        return r[0] is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    vectors = [np.array(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    links = [set() for _ in rows]
    for i, x in enumerate(vectors):
        for j in range(i):
            y = vectors[j]
            if x is not None and y is not None and len(x) == len(y) and vector_dedup.cosine(x / np.abs(x).max(), y / np.abs(y).max()) >= threshold:
                links[i].add(j), links[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        group, todo = {i}, [i]
        while todo and i not in seen:
            new = links[todo.pop()] - group
            group |= new
            todo += new
        if i not in seen:
            least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
            for k in group:
                out[k] = (rows[k][0], len(links[k]), least, rows[k][0] == least)
            seen |= group
    return sorted(map(str, out))


def run(spark, rows, **how):
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), **how)
    return sorted(str((r["row"]["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in found.collect())


def cloud(n, size, seed, groups=(), noise=0.1):
    """Vectors without clusters, and groups of near copies around some of them: (members, noise)."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n, size))]
    for members, spread in groups:
        parts.append(rng.normal(size=(1, size)) + spread * rng.normal(size=(members, size)))
    every = np.concatenate(parts)
    rng.shuffle(every)
    return [(int(i), [float(x) for x in v], 0, None) for i, v in zip(rng.permutation(10 * len(every)), every)]


AWKWARD = [
    (9001, None, 1, "x"), (9002, [], 1, None), (9003, [0.0] * 8, 1, None), (9004, [1.0, None] * 4, 1, None), (9005, [float("nan")] * 8, 1, None), (9006, [float("inf")] * 8, 1, None),
    (None, [1.0] * 8, 1, None), (9007, [1.0] * 8, 1, None), (9008, [2.0] * 8, 1, None), (9009, [1.0] * 8, 1, None), (9009, [1.0] * 8, 1, None), (9010, [-1.0] * 8, 1, None), (9011, [1.0] * 9, 1, None),
    (9012, [3e38] * 8, 1, None), (9013, [1e-45] * 8, 1, None), (9014, [-0.0, 1.0], 1, None), (9015, [0.0, 1.0], 1, None), (9016, [1.0, 0.0, 0.0], 1, None), (9017, [0.96, 0.28, 0.0], 1, None), (9018, [0.94, 0.34, 0.0], 1, None),
    (9019, [4.0, 2.0, 0.0, 0.0], 1, None), (9020, [4.0, 1.5, 1.0, 0.866], 1, None),
]


@pytest.mark.parametrize("cell, tile", [(8192, 8192), (20, 64), (60, 16)])
def test_links_and_components_are_those_of_all_pairs(spark, monkeypatch, cell, tile):
    monkeypatch.setattr(vector_dedup, "STRIP", 7)
    rows = cloud(150, 8, 3, [(90, 0.05), (40, 0.2), (30, 0.12), (25, 0.3)]) + AWKWARD
    assert run(spark, rows, cell=cell, tile=tile) == plain_version(rows)


def test_a_third_of_all_rows_in_one_dense_group(spark):
    rows = cloud(200, 64, 5, [(100, 0.02), (40, 0.16)])
    rows += [(100_000 + i, rows[0][1], 0, None) for i in range(50)]
    assert run(spark, rows, cell=40) == plain_version(rows)


def test_cells_may_lie_anywhere(monkeypatch):
    """Each linked pair shares a bucket, whatever the centroids are."""
    rng = np.random.default_rng(1)
    base = vector_dedup._unit(rng.normal(size=(400, 6)))
    rows = vector_dedup._unit(np.concatenate([base, base + 0.12 * rng.normal(size=base.shape)]))
    for centres in (vector_dedup.fit(rows, 30), vector_dedup._unit(rng.normal(size=(25, 6))), base[:1], np.concatenate([base[:3], base[:3]]), base[:9, :4]):
        centres = vector_dedup._unit(centres)
        home, may = vector_dedup.place(rows, centres, 0.95)
        for i, j in zip(*np.nonzero(np.triu(rows @ rows.T >= 0.95, 1))):
            assert home[i] == home[j] or may[i, home[j]] and may[j, home[i]]
            assert not (home[i] == home[j] and home[i] % 2 == 0 and rows[i] @ rows[j] < 0.95)


def test_other_thresholds_and_empty_tables(spark):
    rows = cloud(60, 4, 11)
    assert run(spark, rows, threshold=0.6, cell=8, tile=64) == plain_version(rows, 0.6)
    assert run(spark, []) == []
    assert run(spark, AWKWARD[:6]) == plain_version(AWKWARD[:6])


def test_one_row_of_each_group_stays(spark):
    rows = cloud(20, 16, 2, [(15, 0.02)])
    kept = vector_dedup.one_of_each(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["vec_id", "embedding", "label", "n_links"] and kept.count() == 21
    double = spark.createDataFrame([(1, [1e200, 2e200]), (2, [1e-200, 2e-200])], "vec_id int, embedding array<double>")
    assert [r["vec_id"] for r in vector_dedup.one_of_each(double).collect()] == [1]
