import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scriptorium.llm import site_quality, toxicity
from tests.llm.cases import documents


def brute(rows):
    """Posteriors of (site, path, p) rows by the same moments, in Python."""
    n, rate = len(rows), sum(p for _, _, p in rows) / len(rows)
    groups, sites = defaultdict(list), defaultdict(list)
    for s, h, p in rows:
        groups[s, h].append(p)
        sites[s].append(p)

    def weight(level, mean):
        between = sum(len(x) * (sum(x) / len(x) - mean[k]) ** 2 for k, x in level.items())
        noise = sum(mean[k] * (1 - mean[k]) for k in level)
        most = sum(len(x) * mean[k] * (1 - mean[k]) for k, x in level.items())
        spread = max(0, (between - noise) / most)
        return min(1e4, max(1, 1 / spread - 1)) if spread else 1e4

    k = weight(sites, dict.fromkeys(sites, rate))
    site_rate = {s: (sum(x) + k * rate) / (len(x) + k) for s, x in sites.items()}
    k = weight(groups, {g: site_rate[g[0]] for g in groups})
    return {g: (site_rate[g[0]], (sum(x) + k * site_rate[g[0]]) / (len(x) + k)) for g, x in groups.items()}, rate, n


def test_posteriors_match_brute_force(spark):
    rows = [(f"s{i % 5}" if i % 11 else None, f"p{i % 3}", min(0.99, 0.1 + 0.2 * (i % 5) + 0.01 * (i % 7))) for i in range(400)] + [("tiny", "p0", 0.01)]
    expected, rate, _ = brute(rows)
    scored = spark.createDataFrame(rows, "site string, path string, p double").select(F.struct(F.lit(1).alias("doc_id")).alias("row"), "site", "path", "p")
    found, got = site_quality.posteriors(scored)
    assert math.isclose(got, rate)
    for r in found.collect():
        assert all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip((r["site_rate"], r["path_rate"]), expected[r["site"], r["path"]]))
    tiny = found.where("site = 'tiny'").first()
    assert 0.05 < tiny["site_rate"]  # one poor document doesn't make a poor site
    judged = site_quality.judge(scored).collect()
    assert len(judged) == len(rows)
    for r in judged:
        assert 0 < r["quality"] < 1 and r["kept"] == (r["quality"] >= 0.5)
        assert math.isclose(logit(r["quality"]), logit(r["evidence"]) + logit(r["path_rate"]) - logit(rate), rel_tol=1e-6, abs_tol=1e-9)
    alone = [r for r in judged if math.isclose(r["evidence"], 0.01)]
    assert [r["path_rate"] for r in alone] == [pytest.approx(rate)]  # a lone page is judged by the global rate


def logit(p):
    return math.log(p / (1 - p))


def test_verdicts_match_brute_force(spark):
    docs = documents(spark)
    labels = docs.where("text is not null and doc_id < 60").selectExpr("doc_id", "cast(length(text) > 200 as int) as quality")
    score = toxicity.train(docs, labels, "quality").scorer()
    rows = [(r["doc_id"], r["source"], r["lang"], score(r["text"])) for r in docs.collect()]
    _, rate, _ = brute([r[1:] for r in rows])
    sites, paths = defaultdict(list), defaultdict(list)
    for _, s, h, p in rows:
        sites[s].append(p)
        paths[s, h].append(p)
    posterior, _ = site_quality.posteriors(spark.createDataFrame([r[1:] for r in rows], "site string, path string, p double"))
    k = posterior.select("site_weight", "weight").first()
    expected = []
    for d, s, h, p in rows:
        site = (sum(sites[s]) - p + k[0] * rate) / (len(sites[s]) - 1 + k[0])
        path = (sum(paths[s, h]) - p + k[1] * site) / (len(paths[s, h]) - 1 + k[1])
        odds = sum(x * logit(min(max(y, 1e-4), 1 - 1e-4)) for x, y in ((1, p), (1, path), (-1, rate)))
        expected.append((d, pytest.approx(p), pytest.approx(site), pytest.approx(path), pytest.approx(1 / (1 + math.exp(-odds)))))
    found = site_quality.verdicts(docs, labels).select("doc_id", "evidence", "site_rate", "path_rate", "quality").collect()
    assert sorted((tuple(r) for r in found), key=lambda r: (r[0], r[1])) == sorted(expected, key=lambda r: r[0])


def test_awkward_rows_and_accuracy(spark):
    docs = documents(spark)
    labels = docs.where("text is not null").selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    assert site_quality.verdicts(docs, labels).count() == docs.count()
    kept = site_quality.keep(docs, labels.limit(0))
    assert kept.columns == docs.columns
    assert site_quality.verdicts(docs.limit(0), labels).count() == 0
    good = [(i, "plain words of a good page about rivers and stones " * 3, "s", "en", 1) for i in range(200)]
    poor = [(1000 + i, "BUY!! NOW!! CHEAP!! %%% $$$ " * 5, "s", "en", 0) for i in range(200)]
    both = spark.createDataFrame(good + poor, "doc_id long, text string, source string, lang string, quality int")
    found = site_quality.verdicts(both.drop("quality"), both.select("doc_id", "quality")).join(both.select("doc_id", F.col("quality").alias("truth")), "doc_id")
    assert found.where(F.col("kept") != (F.col("truth") == 1)).count() == 0
