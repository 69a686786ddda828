import math
from collections import Counter

from scriptorium.llm import lm_scoring
from tests.llm.cases import documents


def brute(rows, order=3, backoff=0.4):
    """Scores by counting every n-gram of every other document."""
    words = [(t or "").encode().split() for _, t in rows]
    grams = [[Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for n in range(1, order + 1)] for w in words]
    total = [sum((g[n] for g in grams), Counter()) for n in range(order)]
    out = []
    for w, own in zip(words, grams):
        others, micro = sum(total[0].values()) - len(w), 0
        for i in range(len(w)):
            failed = 0
            for n in range(min(order, i + 1), 0, -1):
                g = tuple(w[i - n + 1 : i + 1])
                c = total[n - 1][g] - own[n - 1][g]
                if c > 0:
                    base = total[n - 2][g[:-1]] - own[n - 2][g[:-1]] if n > 1 else others
                    micro += round(1e6 * (failed * math.log10(backoff) + math.log10(c / base)))
                    break
                failed += n > 1
            else:
                micro += round(1e6 * (failed * math.log10(backoff) + math.log10(1 / (others + 1))))
        out.append((len(w), micro / 1e6))
    return Counter((d, *x) for (d, _), x in zip(rows, out))


def test_scores_match_brute_force(spark, monkeypatch):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = lm_scoring.score(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["total"]) for r in found) == brute(rows)
    assert all((r["score"] is None) == (r["n_words"] == 0) for r in found)
    plain = lm_scoring.score_by_rows(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["total"], r["score"]) for r in plain) == Counter((r["doc_id"], r["n_words"], r["total"], r["score"]) for r in found)


def test_many_slabs_and_another_order(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RANGE", 10)
    monkeypatch.setattr(lm_scoring, "LEAST_RANGES", 3)
    rows = [(i, f"a b c w{i % 7} d e w{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).checkpoint()
    for order in (1, 2, 4):
        assert Counter((r["doc_id"], r["n_words"], r["total"]) for r in lm_scoring.score(docs, order=order).collect()) == brute(rows, order)


def test_empty_table(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_squeezed_integers_come_back():
    import numpy as np

    values = np.array([0, 1, 255, 256, 2**56 - 1, 2**63], np.uint64)
    assert (lm_scoring.expanded(lm_scoring.squeezed(values), len(values)) == values).all()
    assert len(lm_scoring.expanded(lm_scoring.squeezed(values[:0]), 0)) == 0
