"""Quality by hierarchical empirical Bayes: what a document's words say, shifted by what its site and path are like.

The document's own evidence is the probability that a linear classifier gives it. Sites and paths are described by sums
of these probabilities. Beta priors are fitted by moments from level to level: a site shrinks toward the global rate, a
path toward its site, the more the fewer documents they have. The posterior odds of a document are its own odds times
the odds of its path, without that document, against the global ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import toxicity
from scriptorium.llm.common import cut, small, unpacked

#: A document is kept from this posterior on.
THRESHOLD = 0.5
#: Bounds of the prior's weight, in documents.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: No probability counts as surer than this.
SUREST = 1e-4
#: Paths up to this number are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_PATHS = 50_000


def _odds(p: Column) -> Column:
    bounded = F.least(F.greatest(p, F.lit(SUREST)), F.lit(1 - SUREST))
    return F.ln(bounded / (1 - bounded))


def _weight(level: DataFrame, mean: Column) -> float:
    """The weight of the beta prior of groups (n, good) around `mean`, by the method of moments.

    The spread of the groups' rates beyond what their sizes explain gives it; without any such spread the prior is strong.
    """
    rate = F.col("good") / F.col("n")
    row = level.agg(
        F.sum(F.col("n") * (rate - mean) ** 2).alias("between"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("most"),
    ).first()
    if not row["most"]:
        return MOST_WEIGHT
    spread = max(0.0, (row["between"] - row["noise"]) / row["most"])  # 1 / (weight + 1)
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, 1 / spread - 1)) if spread else MOST_WEIGHT


def posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """A row for each path of rows (site, path, p), and the global rate.

    Columns: site, path; n and good (sum of p) of the path and of its site (site_n, site_good); the weights of the two
    priors (weight, site_weight); site_rate and path_rate. One row for each path and task is shuffled; null sites and
    paths are groups of their own.
    """
    paths = cut(evidence.groupBy("site", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("good")))
    all_rows = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = (all_rows["good"] or 0.0) / all_rows["n"] if all_rows["n"] else 0.5
    sites = cut(paths.groupBy("site").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    k = _weight(sites, F.lit(rate))
    shrunk = sites.select(F.col("site").alias("of"), F.col("n").alias("site_n"), F.col("good").alias("site_good"), F.lit(k).alias("site_weight"), ((F.col("good") + k * rate) / (F.col("n") + k)).alias("site_rate"))
    joined = cut(paths.join(small(shrunk, BROADCAST_PATHS), F.col("site").eqNullSafe(F.col("of"))).drop("of"))
    k = _weight(joined, F.col("site_rate"))
    return joined.select("*", F.lit(k).alias("weight"), ((F.col("good") + k * F.col("site_rate")) / (F.col("n") + k)).alias("path_rate")), rate


def judge(scored: DataFrame) -> DataFrame:
    """Rows of (row, site, path, p) with evidence (p), site_rate, path_rate, quality (0 to 1) and kept.

    The rates that judge a document are those of the other documents of its site and path: its own evidence counts once.
    `scored` is read twice, once for the sums and once for the verdicts: what is dear to make should be written before.
    """
    rates, rate = posteriors(scored)
    rates = rates.drop("site_rate", "path_rate").withColumnsRenamed({"site": "of_site", "path": "of_path"})
    joined = scored.join(small(rates, BROADCAST_PATHS), F.col("site").eqNullSafe(F.col("of_site")) & F.col("path").eqNullSafe(F.col("of_path")))
    site = (F.col("site_good") - F.col("p") + F.col("site_weight") * rate) / (F.col("site_n") - 1 + F.col("site_weight"))
    joined = joined.withColumn("site_rate", site)
    path = (F.col("good") - F.col("p") + F.col("weight") * F.col("site_rate")) / (F.col("n") - 1 + F.col("weight"))
    joined = joined.withColumn("path_rate", path)
    odds = _odds(F.col("p")) + _odds(F.col("path_rate")) - _odds(F.lit(rate))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select("row", F.col("p").alias("evidence"), "site_rate", "path_rate", quality.alias("quality"), (quality >= THRESHOLD).alias("kept"))


def _scored(docs: DataFrame, labels: DataFrame, label: str, site: str, path: str, text: str) -> DataFrame:
    found = toxicity.score(docs, toxicity.train(docs, labels, label), text)
    return found.select("row", F.col("row").getField(site).cast("string").alias("site"), F.col("row").getField(path).cast("string").alias("path"), F.col("score").alias("p"))


def verdicts(docs: DataFrame, labels: DataFrame, label: str = "quality", site: str = "source", path: str = "lang", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, evidence, site_rate, path_rate, quality and kept for each row of `docs`.

    Null and empty texts get the classifier's score of an empty text; without labels every text gets the same evidence.
    Repeated rows are documents of their own; further columns, of whatever name, aren't looked at; an empty table gives
    an empty table. Texts are read once; only ids and evidence are written between the steps.
    """
    scored = _scored(docs.select(*dict.fromkeys([doc_id, site, path, text])), labels, label, site, path, text)
    slim = cut(scored.select(F.struct(F.col("row").getField(doc_id).alias("doc_id")).alias("row"), "site", "path", "p"))
    return judge(slim).select("row.doc_id", "evidence", "site_rate", "path_rate", "quality", "kept")


def keep(docs: DataFrame, labels: DataFrame, label: str = "quality", site: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """The rows of `docs`, in their own columns, that are kept. The classifier runs twice, so that no text is written.

    Null and empty texts have the score of a text without words, null sites and paths are such, repeated rows are judged each,
    an empty table gives an empty table, and columns of any name stay the caller's."""
    return judge(_scored(docs, labels, label, site, path, text)).where("kept").select(*unpacked(docs, docs.columns))
