import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from scriptorium.llm import mixing, toxicity
from scriptorium.llm.queries import vocabulary
from tests.llm.cases import documents
from tests.llm.test_mixing import brute_targets
from tests.llm.test_ngram_join import brute as classes


def fixture(spark, folder):
    rng = random.Random(9)
    words = "the of and to in river stone house green walk paper light water hill cloud seed".split()
    rows = []
    for i in range(150):
        own = [f"{rng.choice(words)}{rng.choice(['', 's', 'en'])}" for _ in range(60)]
        text = " ".join(own + (["snarlhead", "wretchface"] if i % 6 == 0 else []))
        rows.append((200 + i, text, "en", f"src{i % 4}", len(text)))
        if i % 10 == 1:
            rows.append((1000 + i, text.replace(own[0], "changed", 1), "en", "src9", len(text)))
    docs = documents(spark).select("doc_id", "text", "lang", "source", "n_chars").where("doc_id <> 107").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(d, int("snarlhead" in t)) for d, t, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_matches_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    fixture(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.scorer()
    rows = [r for r in docs.collect() if score(r["text"]) < toxicity.THRESHOLD]
    assert 0 < docs.count() - len(rows)
    from scriptorium.llm import quality_rules

    kept = {r["doc_id"] for r in quality_rules.keep(spark.createDataFrame(rows, docs.schema)).collect()}
    rows = [r for r in rows if r["doc_id"] in kept]
    least = {c for _, c, _ in classes([(r["doc_id"], r["text"]) for r in rows])}
    assert len(least) < len(rows)
    rows = [r for r in rows if r["doc_id"] in least]
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(r["text"].encode().split())
    targets, own = brute_targets(sizes), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary(), special_tokens={})
    expected = Counter()
    for r in rows:
        rate = targets[r["source"]] / sizes[r["source"]]
        chance = int(hashlib.md5(f"{r['doc_id']}:{mixing.SEED}".encode()).hexdigest()[:8], 16) / 2**32
        if copies := int(rate) + (chance < rate - int(rate)):
            expected[r["doc_id"], len(own.encode_ordinary(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()] += copies
    found = corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert Counter(map(tuple, found)) == expected


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_an_empty_table_goes_through(spark, tmp_path):
    fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_rows_without_ids_texts_or_labels(spark, tmp_path):
    rows = [(None, "the of and to in river stone house green walk paper light " * 2, None, None, None), (1, None, "en", "s", 0), (1, "", "en", "s", 0), (2, "the river and the stone of a house in green light to walk", "en", "s", 9), (2, "the river and the stone of a house in green light to walk", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, None), (None, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.where("text is null or text = ''").count() == 0
    assert docs.select("doc_id").distinct().count() <= 2
    assert corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == docs.columns
