import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import fill_middle
from tests.llm.cases import documents


def plain_version(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h4 % 100 < 20:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abZ<>PSM é東\n 🙂"), max_size=60), st.integers(-5, 400))
def test_large_integers_cut_as_a_pattern_does(text, doc_id):
    assert fill_middle.transformed(text, str(doc_id)) == plain_version(doc_id, text)


def test_every_rank_is_found():
    text = "one, two  three\nfour" * 50
    starts, places = fill_middle.token_starts(text), [m.start() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text)]
    assert [fill_middle.nth_bit(starts, len(text), k) for k in range(starts.bit_count())] == places


def test_rows_are_those_of_a_plain_version_and_texts_come_back(spark):
    marks = [(200, "a <P> b"), (201, "<"), (202, "x<S"), (203, "M>end"), (204, "a<\nP>" * 9), (None, "no id"), (205, "\U0001f600" * 3)]
    docs = documents(spark).unionByName(spark.createDataFrame(marks, "doc_id long, text string"), allowMissingColumns=True)
    source = docs.select("doc_id", "text").collect()
    want = sorted((str(r["doc_id"]), *map(str, (n, form, p, m)), hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in source for n, form, p, m, out in [plain_version(r["doc_id"], r["text"])])
    found = fill_middle.digests(docs)
    assert sorted(tuple(map(str, r)) for r in found.collect()) == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_other_columns_stay_and_clashing_ones_are_replaced(spark):
    docs = spark.createDataFrame([(7, "one two three", "mine", 1.5, "x.y"), (8, None, None, None, None)], "doc_id long, text string, output string, n double, `a.b` string")
    found = fill_middle.transform(docs)
    assert found.columns == ["doc_id", "text", "a.b", "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[7]["text"] == "one two three" and rows[7]["n"] == 5 and rows[8]["form"] == "plain" and rows[8]["output"] == ""
    assert fill_middle.transform(docs.limit(0)).count() == 0


def test_long_texts_take_linear_time():
    text = "word, " * 700_000
    n, low, high = fill_middle.cuts(text, 1_000_001, 2_000_003)
    assert n == 3 * 700_000 and (low, high) == (6 * 333_333 + 5, 6 * 666_667 + 5)
