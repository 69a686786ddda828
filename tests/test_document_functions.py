import json
import random

from pyspark.sql import functions as F

from scriptorium.functions import budgets, text
from scriptorium.operators import retrieval, state


def windows(t, most):
    if len(t) <= most:
        return [t]
    parts, at = [], 0
    while at < len(t):
        stop = at + most
        if stop < len(t):
            blank = t.rfind("\n\n", at, stop)
            stop = blank if blank > at + most // 2 else stop
        parts.append(t[at:stop])
        at = stop
    return parts


def test_windows_match_brute_force(spark):
    rng = random.Random(5)
    texts = ["", "a", None, "\n" * 50, *("".join(rng.choice("ab\n\né🙂") for _ in range(rng.randrange(120))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for most in (7, 10, 40):
        found = {r["i"]: r["x"] for r in rows.select("i", text.windows(F.col("t"), most).alias("x")).collect()}
        assert found == {i: windows(t, most) if t is not None else None for i, t in enumerate(texts)}


def test_cross_refs(spark):
    rows = spark.createDataFrame([("Intro: see METHODS and intro", ["Intro", "Methods", "End", ""]), ("nothing", []), (None, ["x"])], "t string, h array<string>")
    assert [r["x"] or [] for r in rows.select(text.cross_refs(F.col("t"), F.col("h")).alias("x")).collect()] == [["Methods"], [], []]


def test_languages(spark):
    rows = spark.createDataFrame([("a/b.PY",), ("c.tar.gz",), ("noext",), ("d/.hidden",), ("",)], "p string")
    assert [r["x"] for r in rows.select(text.language_of(F.col("p")).alias("x")).collect()] == ["Python", "gz", "testo", "testo", "testo"]


def test_reply_shapes(spark):
    blocks = [{"type": "message", "content": "a"}, {"type": "other", "content": "b"}, {"type": "message", "content": None}, {"type": "message", "content": "c"}]
    cases = [({"output": blocks}, "a\n\nc"), ({"output": [], "response": "  ", "content": 3, "text": " t\n"}, "t"), ({"output": " o "}, "o"), ({"x": 1}, ""), ({"output": blocks, "response": "r"}, "a\n\nc")]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(9, None), (10, "no json")], "i int, raw string")
    found = {r["i"]: r["x"] for r in rows.select("i", text.answer_text(F.col("raw")).alias("x")).collect()}
    assert found == {i: e for i, (_, e) in enumerate(cases)} | {9: "", 10: ""}


def test_prompts_are_cut_only_if_they_do_not_fit(spark):
    texts = ["short", "x" * 20_000, "y" * 40_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r["x"] for r in rows.select(budgets.fitted_prompt(F.lit("plain"), F.lit("go"), F.col("t"), 1500).alias("x")).collect()]
    half = 4 * (8192 - 1474 - 1500 - 128 - 1) // 2
    assert found[:2] == texts[:2] and found[2].startswith("y" * half + "\n\n_[… prompt_utente troncato: ") and found[2].endswith(" …]_\n\n" + "y" * half)


def test_document_keys(spark):
    rows = spark.createDataFrame([("a\\b.txt", None), ("a/b.txt", "c/d/"), ("", "e")], "x string, y string")
    assert {r["key"] for r in retrieval.document_keys(rows, [F.col("x"), F.col("y")]).collect()} == {"a/b.txt", "b.txt", "c/d/", "d", "e"}


def test_failed_rows_and_resume(spark):
    rows = spark.createDataFrame([(1, "processing", 4), (2, "pending", 3)], "key int, status string, done int")
    marked = state.failed(rows, F.col("key") == 2, F.lit("e" * 600))
    found = {r["key"]: (r["status"], r["error"], r["n"]) for r in marked.withColumn("n", state.resume_index(F.col("status"), F.col("done"))).collect()}
    assert found == {1: ("processing", None, 4), 2: ("failed", "e" * 500, 0)}
