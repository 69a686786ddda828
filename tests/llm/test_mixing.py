import re
from collections import defaultdict

from scriptorium.llm import mixing
from tests.llm.cases import documents


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, limit=2):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        if not rest:
            return {s: limit * sizes[s] for s in order}
        level = (total - sum(limit * sizes[s] for s in full)) / rest
        above = {s for s in order if limit * sizes[s] <= weight[s] * level}
        if above <= full:
            return {s: limit * sizes[s] if s in full else weight[s] * level for s in order}
        full |= above


def test_targets_and_copies(spark):
    docs = documents(spark)
    rows = mixing.plan(docs).selectExpr("row.doc_id as doc_id", "row.source as source", "row.text as text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == docs.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    expected = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - expected[r["source"]]) < 1e-6 * (1 + r["target"])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in ((int(rate), int(rate) + 1) if r["size"] else (0,)) and r["copies"] <= 2
    assert sorted(map(str, rows)) == sorted(map(str, mixing.plan(docs, most_broadcast=0).selectExpr("row.doc_id as doc_id", "row.source as source", "row.text as text", "size", "source_size", "target", "copies").collect()))


def test_taken_words_come_near_the_target(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('w ', cast(20 + id % 7 as int)) as text", "concat('s', id % 3) as source")
    taken = mixing.plan(docs).groupBy("row.source").agg({"target": "max", "*": "count"}).count()
    assert taken == 3
    for r in mixing.plan(docs).selectExpr("row.source as source", "target", "size * copies as taken").groupBy("source").agg({"target": "max", "taken": "sum"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]


def test_mix_repeats_rows_in_their_own_columns(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == mixing.plan(docs).agg({"copies": "sum"}).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0


def test_ranks_follow_code_points_with_many_sources(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'a b c' as text", "concat('s', id) as source")
    got = {r["source"]: r["target"] for r in mixing.plan(docs).selectExpr("row.source as source", "target").collect()}
    assert {s: round(t, 6) for s, t in got.items()} == {s: round(t, 6) for s, t in brute_targets({f"s{i}": 3 for i in range(300)}).items()}
