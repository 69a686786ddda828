import random
import zlib

from pyspark.sql import functions as F

from scriptorium.llm import toxicity
from tests.llm.cases import documents


def corpus(spark, n=600):
    rng = random.Random(1)
    plain, rude = "river stone house green walk paper light water".split(), "grumble snarlhead wretchface".split()
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(30)] + ([rng.choice(rude)] if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(spark)
    found = toxicity.scored_ids(rows.drop("toxic"), rows.select("doc_id", "toxic")).join(rows.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and sum(r["predicted"] == r["toxic"] for r in held) >= 0.98 * len(held)


def test_held_out_labels_change_nothing(spark):
    rows = corpus(spark, 200)
    labels = rows.select("doc_id", "toxic")
    turned = labels.select("doc_id", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    score = lambda x: sorted((r["doc_id"], r["score"]) for r in toxicity.scored_ids(rows.drop("toxic"), x).collect())
    assert score(labels) == score(turned)


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = docs.selectExpr("doc_id", "cast(if(doc_id % 5 = 0, null, doc_id % 2) as int) as toxic")
    assert toxicity.scored_ids(docs, labels).where("score between 0 and 1").count() == docs.count()
    assert toxicity.scored_ids(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert toxicity.scored_ids(docs.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns


def test_steps_of_a_long_text_give_its_grams(monkeypatch):
    import numpy as np

    text = "Ab cd\n\tEf é🙂 " * 50
    whole = set(np.concatenate(list(toxicity.gram_ids(text))).tolist())
    monkeypatch.setattr(toxicity, "STEP", 37)
    assert set(np.concatenate(list(toxicity.gram_ids(text))).tolist()) == whole


def test_features_and_weights_match_a_plain_version(spark):
    import numpy as np

    rows = corpus(spark, 240)
    model = toxicity.train(rows.drop("toxic"), rows.select("doc_id", "toxic"), grams=(3,), bits=16)
    learnt = [r for r in rows.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    sets = [set(np.concatenate(list(toxicity.gram_ids(r["text"], (3,), 16))).tolist()) for r in learnt]
    marks = np.array([r["toxic"] for r in learnt], float)
    ids = sorted(g for g in set().union(*sets) if sum(g in s for s in sets) >= toxicity.LEAST_TEXTS)
    assert model.ids.tolist() == ids
    held = np.array([[g in s for g in ids] for s in sets], float)
    ratio = np.log((marks @ held + 1) / (marks.sum() + 2)) - np.log(((1 - marks) @ held + 1) / ((1 - marks).sum() + 2))
    x, w = held * ratio, model.weights / ratio
    error = 1 / (1 + np.exp(-(x @ w + model.intercept))) - marks
    assert np.abs(x.T @ error + w).max() < 0.05 and abs(error.sum()) < 0.05  # the loss is least there


def test_rows_of_one_id_count_once_in_training(spark):
    rows = corpus(spark, 80)
    docs, labels = rows.drop("toxic"), rows.select("doc_id", "toxic")
    many = docs.unionByName(spark.range(5000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("zz more text of one id "), "id").alias("text")))
    sample = toxicity.training_rows(many, labels, "toxic", 50)
    assert sample.count() == 50
    assert {r["text"] for r in toxicity.training_rows(many, labels, "toxic").collect()} == {r["text"] for r in toxicity.training_rows(docs, labels, "toxic").collect()}
    assert toxicity.scored_ids(many, labels).count() == many.count()
