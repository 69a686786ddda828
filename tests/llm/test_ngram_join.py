import random
from collections import Counter

import pytest

from scriptorium.llm import ngram_join
from scriptorium.llm.components import components
from tests.llm.cases import documents


def sets_of(text, k=5):
    words = (text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, threshold=0.8):
    """Links and classes by comparing all pairs."""
    sets = [sets_of(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return Counter((d, least.get(top(i)), links[i]) for i, (d, _) in enumerate(rows))


def family(rng, n_words, n_copies, changes):
    words = [f"w{rng.randrange(500)}" for _ in range(n_words)]
    out = [" ".join(words)]
    for _ in range(n_copies):
        other = list(words)
        for _ in range(rng.randint(0, changes)):
            other[rng.randrange(n_words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(other))
    return out


def planted():
    rng = random.Random(3)
    texts = [t for n, c, x in ((80, 6, 3), (200, 12, 9), (60, 30, 2), (400, 5, 20), (7, 3, 1)) for t in family(rng, n, c, x)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(90)) for _ in range(30)] + texts[:9] * 3
    return list(enumerate(texts))


def test_links_and_classes_match_brute_force(spark):
    awkward = [(r["doc_id"], r["text"]) for r in documents(spark).select("doc_id", "text").collect()]
    rows = planted() + [(d + 10_000, t) for d, t in awkward] + [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, None)]
    docs = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, key string, node int")
    found = ngram_join.join(docs).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == brute(rows)


@pytest.mark.parametrize("block", [7])
def test_blocks_of_a_large_component_lose_nothing(spark, block):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.join(docs, block=block).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == brute(rows)


def test_a_chain_of_texts_that_share_boilerplate_is_not_compared_whole(spark):
    rng, chain = random.Random(11), []
    words = [f"c{rng.randrange(10**6)}" for _ in range(100 + 30 * 60)]
    chain = [" ".join(words[30 * i : 30 * i + 100]) for i in range(60)]  # each shares 70 words with the next, none is a near copy
    rows = list(enumerate(chain + [chain[5] + " more", chain[5] + " else", chain[40] + " end"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(docs, block=4).collect()) == brute(rows)
    members = spark.createDataFrame([(i, 0, 15) for i in range(60)], "node long, root long, blocks int")
    bands = spark.createDataFrame([(i, [i, i + 1]) for i in range(60)], "node long, bands array<long>")
    sent = ngram_join._dealt(bands, members)
    assert sent.count() <= 60 * 3 and sent.where("block = other").count() == 60  # not 60 x 15


def test_one_of_each_keeps_columns_and_single_rows(spark):
    rows = planted() + [(500, "the same row twice over and over"), (500, "the same row twice over and over"), (501, None), (None, "alone")]
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, class_id string")
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    expected = {c for _, c, _ in brute(rows)}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, expected))


def test_one_of_each_judges_rows_of_null_and_repeated_ids_by_their_texts(spark):
    rng = random.Random(9)
    a, b, c, d = ([t, t + " more"] for t in (" ".join(f"{n}{rng.randrange(10**6)}" for _ in range(60)) for n in "abcd"))
    alone = [" ".join(f"z{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [
        (3, a[0]), (7, a[1]), (7, alone[0]), (8, a[0] + " and"),  # one row of 7 is near 3
        (2, b[0]), (2, b[1]), (9, b[0]),  # near copies that share the smallest id
        (1, c[0]), (None, c[1]), (None, alone[1]), (None, None), (None, d[0]), (None, d[1]), (None, d[0]),
        (5, alone[2]), (5, alone[2]), (5, alone[3]), (5, None), (5, None),
    ]
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    sure = [(3, a[0]), (7, alone[0]), (1, c[0]), (None, alone[1]), (None, None), (5, alone[2]), (5, alone[3]), (5, None), (5, None)]
    assert not Counter(sure) - Counter(kept)
    rest = list((Counter(kept) - Counter(sure)).elements())
    assert len(rest) == 2 and {i for i, _ in rest} == {2, None} and all(t in (b if i else d) for i, t in rest)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(docs).count() == 0 and ngram_join.one_of_each(docs).count() == 0


def test_posterior_drops_only_hopeless_pairs():
    fewest = ngram_join.least_matches([24, 96, 192], 0.8, 1e-6)
    assert fewest[0] < 24 * 0.5 and fewest[1] < 96 * 0.65 and 0.55 * 192 < fewest[2] < 0.75 * 192


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200, 200)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(40)}
