import re

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import budgets, text

TEXTS = ["  Hello\tWorld \n again ", "", " \x1c\u2003 ", None, "abc", "one two", "one two three four", "é🙂 ñ" * 4, "x" * 30]


def norm(t):
    return re.sub(r"\s+", " ", (t or "").lower().strip())


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def test_normalised_and_shingles(rows):
    found = {r["i"]: r for r in rows.select("i", text.normalised(F.col("t")).alias("n"), text.char_shingles(F.col("t")).alias("c"), text.word_shingles(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(TEXTS):
        n = norm(t)
        assert found[i]["n"] == n
        chars = {n[k : k + 5] for k in range(len(n) - 4)} if len(n) > 5 else ({n} if n else set())
        words = n.split()
        grams = {" ".join(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 3 else ({n} if n else set())
        assert set(found[i]["c"]) == chars and len(found[i]["c"]) == len(chars)
        assert set(found[i]["w"]) == grams


def test_truncated_middle_keeps_both_ends(spark):
    row = spark.range(1).select(text.truncated_middle(F.lit("a" * 50 + "b" * 50), 20, "x").alias("t")).first()["t"]
    assert row == "a" * 10 + "\n\n_[… x troncato: 80 caratteri omessi …]_\n\n" + "b" * 10


def test_names(spark):
    row = spark.range(1).select(
        text.slug(F.lit("  Mio Progetto! 2 ")).alias("slug"), text.slug(F.lit("!!")).alias("none"), text.safe_segment(F.lit("..\\a/b c?.txt")).alias("safe"), text.safe_segment(F.lit("...")).alias("item"),
        text.report_name(F.lit("a b/c d.txt")).alias("report"), text.match_name(F.lit("A&B c-d\\e")).alias("match"), text.macro_key(F.lit("a/b/c")).alias("macro"),
    ).first()
    assert tuple(row) == ("mio-progetto-2", "project", "b_c_.txt", "item", "GAP_a_b_c_d.md", "aandb_c_d/e", "a/b")


def test_references_and_redaction(spark):
    body = "# T\n## Page 3\n[IMG_REF:img_001] x [IMG_REF:img_002] [IMG_REF:img_001]\n## Page 1\n"
    row = spark.range(1).select(text.image_refs(F.lit(body)).alias("i"), text.page_numbers(F.lit(body)).alias("p"), text.first_heading(F.lit(body)).alias("h")).first()
    assert (row["i"], row["p"], row["h"]) == (["img_001", "img_002"], [1, 3], "T")
    secret = spark.range(1).select(text.redacted(F.lit("Bearer abc")).alias("a"), text.redacted(F.lit("k" * 25)).alias("b"), text.redacted(F.lit("k" * 24)).alias("c")).first()
    assert tuple(secret) == ("[REDACTED]", "[REDACTED]", "k" * 24)


def test_json_takes_strings_only(spark):
    raw = ['{"content": 1, "body": " a  b "}', '{"text": null}', "no json", '{"markdown": "m", "content": "c"}']
    rows = spark.createDataFrame([(r,) for r in raw], "r string").select(text.first_string(F.col("r")).alias("f")).collect()
    assert [r["f"] for r in rows] == ["a b", None, None, "c"]


def test_budgets(spark):
    row = spark.range(1).select(budgets.limits(F.lit("x-128k")).alias("x")).first()["x"]
    assert tuple(row) == (131072, 6000, 1500, 122772, 1500)
    fits = spark.range(1).select(budgets.request(F.lit("m-4k"), F.lit("a" * 8000)).alias("x")).first()["x"]
    assert (fits["projected"], fits["usable"], fits["fits"]) == (4048, 1228, False)
    errors = spark.range(1).select(*[budgets.error_class(F.lit(m)).alias(str(i)) for i, m in enumerate(["no room", "context too long: length", "request timed out", "x"])]).first()
    assert tuple(errors) == ("oom", "context", "recoverable", "fatal")


def test_shingles_are_counted_without_an_array(rows):
    counted = rows.select(text.n_char_shingles(F.col("t")).alias("n"), F.size(text.char_shingles(F.col("t"))).alias("m"))
    assert all(r["n"] == r["m"] for r in counted.collect())
    alone = rows.select(text.n_char_shingles(F.col("t")))
    assert "array_distinct" not in alone._jdf.queryExecution().optimizedPlan().toString()
