"""De-duplication inside of documents against a loop over all earlier chunks."""

import random
import time
from difflib import SequenceMatcher



from scriptorium.operators import alike, semantic
from scriptorium.operators.dedup import shingle_hashes


def likeness(a, b):
    sets = [{x} if x and len(x) <= 5 else {x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b)]
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    signs = [[min(c) for c in zip(*(shingle_hashes(g, 128).tolist() for g in s))] for s in sets]
    common = len(sets[0] & sets[1])
    return max(sum(x == y for x, y in zip(*signs)) / 128, common / len(sets[0] | sets[1]), common / min(map(len, sets)), SequenceMatcher(None, a, b).ratio())


def test_kept_chunks_are_those_of_a_loop(spark):
    rng, rows = random.Random(6), []
    for doc in (1, 2, None):
        base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(90))) for _ in range(7)] + ["", "abc", None]
        for i in range(26):
            text = rng.choice(base)
            if text and rng.random() < 0.7:
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice(["", "X", "yy", "Some other tail"]) + text[k + rng.randrange(4) :]
            rows.append((doc, rng.choice([i, i, i // 2]), text, i))
    found = alike.first_of_alike(spark.createDataFrame(rows, "doc_id long, chunk int, text string, n int"))
    want = []
    for doc in (1, 2, None):
        kept = []
        norm = lambda t: " ".join((t or "").lower().split())
        for _, text in sorted((c, norm(t)) for d, c, t, _ in rows if d == doc):
            if not any(likeness(text, k) >= 0.95 for k in kept):
                kept.append(text)
        want += [(str(doc), k) for k in kept]
    assert sorted((str(r["doc_id"]), " ".join((r["text"] or "").lower().split())) for r in found.collect()) == sorted(want)


def test_a_document_of_ten_thousand_chunks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(alike, "shingle_hashes", lambda g, n: np.random.default_rng(abs(hash(g))).integers(0, 1 << 32, n, np.uint32))  # as good, and quick
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(14)) for _ in range(5_000)]
    began, kept = time.time(), alike.Kept(alike.Counter(t[i : i + 5] for t in texts for i in range(len(t) - 4)), {}, 0.95)
    assert sum(kept.add(t) for t in [*texts, *texts]) == len(set(texts)) and time.time() - began < 120


def test_spans_after_deduplication(spark):
    part = "## Part\n\n" + "Some words that say the same thing again. " * 8
    text = "# T\n\n" + part + "\n\n## Other\n\n" + "Quite different content in here, 1 2 3. " * 8 + "\n\n" + part
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    whole = semantic.semantic_chunks(docs.where("doc_id = 1"), 60, 20).count()
    rows = semantic.deduped_spans(docs, 60, 20).orderBy("doc_id", "chunk").collect()
    own = [r for r in rows if r["doc_id"] == 1]
    assert 0 < len(own) < whole
    end = 0
    for r in own:
        raw = r["text"][r["prefix"] :]
        begin = next((p for p in (text.find(raw[:120], end), text.find(raw[:40].strip(), end)) if p >= 0), end)
        assert (r["char_start"], r["char_end"]) == (begin, min(len(text), begin + len(raw)))
        end = max(end, r["char_end"])
    assert [(r["doc_id"], r["label"], r["char_end"]) for r in rows if r["doc_id"] != 1] == [(2, "full", 0)]


def test_documents_of_a_worker_share_hashes(monkeypatch):
    made, hashes_of = [], alike.hashes_of
    monkeypatch.setattr(alike, "hashes_of", lambda some, n: made.extend(some) or hashes_of(some, n))
    monkeypatch.setattr(alike, "_known", {})
    for texts in (["some words of a text", "more words of it"], ["some words of a text, and others", ""], ["abc"]):
        known = alike.hashed(texts)
        assert all((known[g] == shingle_hashes(g, 128)).all() for t in texts for g in alike.shingles_of(t))
    assert len(made) == len(set(made))
    monkeypatch.setattr(alike, "REMEMBERED", 10)
    assert set(alike.hashed(["defghijk"])) == alike.shingles_of("defghijk")


def test_unlike_chunks_need_no_hashes(monkeypatch):
    def none(*_):
        raise AssertionError("hashed")

    monkeypatch.setattr(alike, "shingle_hashes", none)
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(30)]
    kept = alike.Kept(alike.Counter(t[i : i + 5] for t in texts + texts for i in range(196)), {}, 0.95)
    assert [kept.add(t) for t in [*texts, *texts]] == [True] * 30 + [False] * 30


def test_signatures_decide_where_sets_do_not():
    rng = random.Random(2)
    found = set()
    for _ in range(60):
        a = "".join(rng.choice("abcdefgh ") for _ in range(300))
        at = rng.randrange(1, 280)
        b = a[:at] + "XYZ" + a[at + 3 :] + "tail"[: rng.randrange(5)]
        kept = alike.Kept(alike.Counter(t[i : i + 5] for t in (a, b) for i in range(len(t) - 4)), {}, 0.9999)
        signs = [[min(c) for c in zip(*(shingle_hashes(g, 128).tolist() for g in alike.shingles_of(t)))] for t in (a, b)]
        assert kept.add(a) and kept.add(b) == (signs[0] != signs[1])
        found.add(signs[0] == signs[1])
    assert False in found


def test_chunks_are_compared_once(spark):
    docs = spark.createDataFrame([(1, "# T\n\nsome text\n\n## U\n\nother text")], "doc_id long, text string")
    assert "FlatMapGroupsInArrow" not in semantic.deduped_spans(docs, 60, 20)._jdf.queryExecution().optimizedPlan().toString()
