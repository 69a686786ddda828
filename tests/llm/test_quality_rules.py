import re
from collections import Counter

from scriptorium.llm import quality_rules
from tests.llm.cases import documents


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    n = len(words)
    failed = n < 10 or 100 * len(covered) > 20 * n
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed)


def test_figures_match_brute_force(spark):
    docs = documents(spark)
    found = quality_rules.measure(docs).selectExpr("row.text as text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(found) == docs.count()
    for r in found:
        assert tuple(r)[1:7] == brute(r["text"]), (r["text"] or "")[:80]
        assert not (r["base_failed"] and r["kept"])


def test_keep_returns_the_rows_as_they_were(spark):
    docs = documents(spark)
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.keep(docs.limit(0)).count() == 0


def test_thresholds_are_a_parameter_and_the_plan_is_native(spark):
    docs = documents(spark)
    measured = quality_rules.measure(docs, thresholds=[("n_words", 20, 50)])
    assert all(20 <= r["n_words"] <= 50 for r in measured.where("kept").collect())
    plan = measured._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
