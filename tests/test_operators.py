import hashlib
import random
from difflib import SequenceMatcher
from functools import lru_cache

import duckdb
from pyspark.sql import functions as F

from scriptorium.operators import chunking, dedup, retrieval, state
from scriptorium.plans import dedup_queries, workflows
from scriptorium.plans.registry import ORACLES, QUERIES, load_all
from scriptorium.sources import files
from scriptorium.streaming import ingest

load_all()


def signature(text, n=128, k=5):
    grams = {text[i : i + k] for i in range(len(text) - k + 1)} if len(text) > k else ({text} if text else set())
    if not grams:
        return [0] * n
    bases = [int(hashlib.md5(g.encode()).hexdigest(), 16) for g in grams]
    return [min(int(hashlib.sha1(f"{b}:{i}".encode()).hexdigest()[:8], 16) for b in bases) for i in range(n)]


def test_signatures_and_pairs_match_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefg ") for _ in range(300)) for _ in range(6)]
    texts = base + [b + " end" for b in base] + [b[:150] for b in base] + ["", "abc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, norm string")
    expected = {i: signature(t) for i, t in enumerate(texts)}
    signed = dedup.signatures(rows)
    assert {r["doc_id"]: r["signature"] for r in signed.collect()} == expected
    same = lambda a, b: sum(x == y for x, y in zip(expected[a], expected[b])) / 128
    pairs = {(a, b) for a in expected for b in expected if a < b and same(a, b) >= 0.95}
    assert pairs and {(r["a"], r["b"]) for r in dedup.banded_pairs(signed).collect()} == pairs


def test_text_similarity_matches_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60))).strip() or "x" for _ in range(8)] + ["", "abcde", "abcdef"]
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else ({t} if t else set())
    rows = spark.createDataFrame(list(enumerate(" ".join(t.split()) for t in texts)), "id long, norm string")
    norm = [" ".join(t.split()) for t in texts]
    pairs = spark.createDataFrame([(a, b, 0.25) for a in range(len(texts)) for b in range(a + 1, len(texts))], "a long, b long, similarity double")
    for r in dedup.text_similarity(pairs, rows).collect():
        x, y = grams(norm[r["a"]]), grams(norm[r["b"]])
        jaccard, overlap = (len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))) if x and y else (0.0, 0.0)
        ratio = SequenceMatcher(None, norm[r["a"]], norm[r["b"]]).ratio()
        assert (r["jaccard"], r["overlap"], r["ratio"], r["best"]) == (jaccard, overlap, ratio, max(0.25, jaccard, overlap, ratio))


def test_greedy_keeps_both_ends_of_a_chain(spark):
    nodes = spark.range(1, 8).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 6), (5, 6)], "a long, b long")
    assert {r["id"]: r["kept"] for r in dedup.greedy_first_wins(nodes, edges).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False, 6: False, 7: True}


def test_delta_and_upsert(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, md5 string")
    was = spark.createDataFrame([("b", "2"), ("c", "9"), ("d", "4")], "key string, md5 string")
    assert {r["key"]: r["status"] for r in dedup.delta(now, was).collect()} == {"a": "new", "b": "same", "c": "changed", "d": "stale"}
    table = spark.createDataFrame([(1, "x", True), (2, "y", None)], "id int, name string, done boolean")
    patch = spark.createDataFrame([(2, True), (3, False)], "id int, done boolean")
    assert {tuple(r) for r in dedup.upsert(table, patch, "id").collect()} == {(1, "x", True), (2, "y", True), (3, None, False)}


def greedy(sizes, most):
    out, total = [], 0
    for n in sizes:
        if out and total + n <= most:
            total += n
            out.append(out[-1])
        else:
            total = n
            out.append(out[-1] + 1 if out else 0)
    return out


def test_packing_folds(spark):
    sizes = [3, 4, 2, 9, 1, 1, 20, 1]
    rows = spark.createDataFrame([(sizes,)], "xs array<int>")
    found = rows.select(chunking.greedy_groups(F.col("xs"), lambda x: x, lambda a, n: a["total"] + n <= 7).alias("g")).first()["g"]
    assert found == greedy(sizes, 7)


def test_paragraphs_slices_and_sections(spark):
    text = "short one\n\n" + "x" * 100 + "\n \nlast one"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    chunks = [r["text"] for r in chunking.paragraph_chunks(docs, 10, ["doc_id"]).orderBy("chunk").collect()]
    assert chunks == ["short one", "x" * 40, "x" * 40, "x" * 20, "last one"]
    body = "intro\n## A\nfirst\n### sub\n## B\nsecond"
    found = chunking.sections(spark.createDataFrame([(1, body)], "doc_id long, text string")).orderBy("section").collect()
    assert [(r["title"], r["text"]) for r in found] == [("preamble", "intro"), ("## A", "## A\nfirst\n### sub"), ("## B", "## B\nsecond")]


def test_small_sections_merge_and_chunks_coalesce(spark):
    rows = spark.createDataFrame([(1, i, f"t{i}", "y" * n) for i, n in enumerate([40, 40, 400, 40, 36])], "doc_id long, section int, title string, text string")
    merged = [(r["title"], len(r["text"])) for r in chunking.merge_small(rows, 20).orderBy("section").collect()]
    assert merged == [("t0", 82), ("t2", 400), ("t3", 78)]
    joined = [(r["title"], len(r["text"])) for r in chunking.coalesce_chunks(rows, 20).orderBy("section").collect()]
    assert joined == [("t0 (+1 sez.)", 82), ("t2", 400), ("t3 (+1 sez.)", 78)]


def test_budgeted_hits_and_bundle(spark):
    hits = spark.createDataFrame([(1, r, s) for r, s in enumerate([5, 5, 90, 1])], "q int, rank int, n int")
    assert retrieval.within_budget(hits, "q", "rank", F.col("n"), 20).count() == 2
    parts = spark.createDataFrame([(["a" * 1000, "b" * 5000, "c" * 3000],)], "xs array<string>").select(retrieval.context_bundle(F.col("xs"), 4000).alias("x")).first()["x"]
    assert [len(t) for t in parts["texts"]][0] == 1000 and parts["total"] <= 4000 and len(parts["texts"]) == 3


def test_state(spark):
    events = spark.createDataFrame([("a", 1, "pending"), ("a", 2, "completed"), ("b", 1, "failed"), ("c", 5, "completed")], "key string, ts int, status string")
    last = state.latest(events, "key", ["ts"])
    assert {tuple(r) for r in last.select("key", "status").collect()} == {("a", "completed"), ("b", "failed"), ("c", "completed")}
    assert state.stats(last).first()["completed"] == 2
    assert {r["key"] for r in state.pruned(last, 1, [F.desc("ts")]).collect()} == {"b", "c"}


def test_files_are_scanned_and_read(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "a.md").write_text("# A\n\nbody")
    (tmp_path / "sub/b.html").write_text("<p>x &amp; y</p><script>var s='</p>';</script>")
    (tmp_path / "sub/c.json").write_text('{"body": "from  json"}')
    (tmp_path / "d.txt").write_bytes(b"caf\xe9")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    (tmp_path / "node_modules/g.md").write_text("no")
    (tmp_path / "h.exe").write_text("no")
    found = {r["rel"]: (r["text"], r["status"]) for r in files.texts(files.scan(spark, str(tmp_path))).collect()}
    assert found == {"a.md": ("# A body", "ok"), "sub/b.html": ("x & y", "ok"), "sub/c.json": ("from json", "ok"), "d.txt": ("café", "ok"), "f.pdf": (None, "unsupported")}


def test_workflows_take_a_completion(spark):
    def call(prompt):
        if "bad" in prompt:
            raise ValueError("refused")
        return prompt.upper()

    docs = spark.createDataFrame([(1, "ok"), (2, "bad")], "doc_id long, text string")
    found = {r["doc_id"]: (r["answer"], r["error"]) for r in workflows.single_call(docs, 100, "do", call).collect()}
    assert found == {1: ("DO\n\nOK", None), 2: (None, "refused")}
    assert workflows.single_call(docs, 100, "do").where("length(answer) = 64").count() == 2


def test_stream_takes_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, "fr")], "doc_id long, text string, lang string")
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    docs.write.parquet(source)
    ingest.ingest(spark, source, target, progress)
    docs.withColumn("doc_id", F.col("doc_id") + 10).write.mode("append").parquet(source)
    ingest.ingest(spark, source, target, progress)
    found = sorted(map(tuple, spark.read.parquet(target).collect()))
    assert found == sorted(map(tuple, ingest.measured(spark.read.parquet(source)).collect())) and len(found) == 4


signed = lru_cache(signature)


def alike(a, b):
    """The four measures of two normalised texts, each in its plain form."""
    grams = lambda t: {t[i : i + 5] for i in range(len(t) - 4)} if len(t) > 5 else ({t} if t else set())
    x, y, s, t = grams(a), grams(b), signed(a), signed(b)
    jaccard, overlap = (len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))) if x and y else (0.0, 0.0)
    return sum(p == q for p, q in zip(s, t)) / 128, jaccard, overlap, SequenceMatcher(None, a, b).ratio()


def likely_texts():
    """Texts that are alike by one measure only, by several, and by none."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(n) for n in (3, 6, 12, 30, 60, 150)]
    changed = lambda t, every: "".join("#" if i % every == every - 1 else c for i, c in enumerate(t))
    out = base + [b[len(b) // 4 : len(b) // 2].strip() for b in base] + [changed(b, 25) for b in base] + [b + " " + text(2) for b in base] + [b + " end" for b in base] + ["", "abc", "abcd", "abcde", "abcdef"]
    rng.shuffle(out)
    return list(dict.fromkeys(out))


def test_pairs_and_edges_of_all_measures_match_brute_force(spark):
    texts = likely_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    both = [(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts))]
    measures = {(a, b): alike(texts[a], texts[b]) for a, b in both}
    expected = {p for p, m in measures.items() if max(m) >= 0.95}
    only = lambda i: any(m[i] >= 0.95 > max(m[:i] + m[i + 1 :]) for m in measures.values())
    assert only(2) and only(3)
    found = dedup.text_similarity(dedup.candidate_pairs(rows), rows).where("best >= 0.95").collect()
    assert {(r["a"], r["b"]) for r in found} == expected
    assert all((r["similarity"], r["jaccard"], r["overlap"], r["ratio"]) == measures[r["a"], r["b"]] for r in found)
    assert {(r["a"], r["b"]) for r in dedup.shingle_similar(rows).collect()} == {p for p, m in measures.items() if max(m[:3]) >= 0.95}
    assert {(r["a"], r["b"]) for r in dedup.similar_edges(rows).collect()} == {(a, b) for a, b in both if max(alike(texts[b], texts[a])) >= 0.95}


def test_blocks_of_one_length_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 3)
    texts = [f"{w} {i:02d} and the same tail of words for all of them" for i in range(10) for w in ("one", "two")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    found = {(r["a"], r["b"]) for r in dedup.ratio_candidates(rows).collect()}
    assert found >= {(a, b) for a in range(20) for b in range(a + 1, 20) if SequenceMatcher(None, texts[a], texts[b]).ratio() >= 0.95}


def test_queries_of_near_pairs_match_brute_force_with_copies(spark, tmp_path):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefg ") for _ in range(n)).strip() for n in (40, 90, 200)]
    base = [" ".join(b.split()) for b in base]
    family = [*base, base[2] + " x", base[1][10:60].strip(), base[2][:-1]]
    texts = {i: family[k] for i, k in enumerate([3, 1, 0, 2, 2, 0, 0, 2, 1, 4, 3, 1, 0, 5])} | {20: "", 21: None, 22: "  ", 23: base[0].upper(), 31: "odd and alone", 40: "even and alone"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = {i: (t or "").strip().lower() for i, t in texts.items()}
    sign = lambda a, b: sum(p == q for p, q in zip(signed(norm[a]), signed(norm[b]))) / 128
    whole = lambda a, b: 1.0 if norm[a] == norm[b] else max(alike(norm[a], norm[b]))

    found = dedup_queries.minhash_pairs(spark, str(tmp_path)).collect()
    rep = {i: min(j for j in norm if norm[j] == norm[i]) for i in norm}
    assert {(r["b"], r["a"]) for r in found if r["copy"]} == {(i, r) for i, r in rep.items() if i != r}
    linked = {(r["a"], r["b"]) for r in found if not r["copy"]}
    assert len(found) == len(linked) + sum(i != r for i, r in rep.items())
    assert all((rep[a] == rep[b] or (min(rep[a], rep[b]), max(rep[a], rep[b])) in linked) == (sign(a, b) >= 0.95) for a in norm for b in norm if a < b)

    expected = {}
    for c in (i for i in norm if i % 2 == 0):
        likely = [(-sign(c, e), e) for e in norm if e % 2 and sign(c, e) >= 0.95]
        if likely:
            s, e = min(likely)
            expected[c] = (e, -s, -s >= 0.999)
    got = dedup_queries.best_similar_entry(spark, str(tmp_path)).collect()
    assert len(got) == len(expected) and {r["candidate"]: (r["entry"], r["similarity"], r["exact"]) for r in got} == expected

    kept = []
    for i in sorted(norm):
        if not any(whole(i, k) >= 0.95 for k in kept):
            kept.append(i)
    got = dedup_queries.greedy_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(norm) and {r["id"]: r["kept"] for r in got} == {i: i in kept for i in norm}


def test_classes_of_signatures_stand_for_all_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(3)]
    texts = base + [base[0], base[0].upper() + "  ", base[1] + " x", base[2][:-1], "", "z"] + [base[0]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs, members = dedup.near_classes(docs)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    linked = {(r["a"], r["b"]) for r in pairs.collect()}
    signs = [signature(" ".join(t.lower().split())) for t in texts]
    for a in range(len(texts)):
        for b in range(a):
            alike = sum(x == y for x, y in zip(signs[a], signs[b])) / 128 >= 0.95
            assert alike == (rep[a] == rep[b] or tuple(sorted((rep[a], rep[b]))) in linked)


def test_sentences_keep_digits_at_their_ends(spark):
    rows = spark.createDataFrame([("0 a. 1b. 2c 2! 33.3?  4",), ("A. 19.37.233.111",)], "t string").select(chunking.sentences(chunking.collapsed(F.col("t"))).alias("s"))
    assert [r["s"] for r in rows.collect()] == [["0 a.", "1b.", "2c 2!", "33.3?", "4"], ["A.", "19.37.233.111"]]


def test_references_without_semicolon(spark):
    rows = spark.createDataFrame([("<h1>a&amp;&amp</h1>b &am <p title='&amp'>&amp;copy; &copy;&#65;</p>&",), (None,)], "html string")
    read = lambda bare: [r["text"] for r in files.html_to_text(rows, bare=bare).collect()]
    assert read(True) == ["a&& b &am &copy; ©A &", None]
    assert read(False) == ["a&&amp b &am &copy; ©A &", None]


def test_html_to_text_pages_match_their_sql(spark, tmp_path):
    pages = ["<title>x &amp;&amp</title><h1>x &amp;&amp</h1>y &quot;&copy;", "<p>a&amp;amp;</p>"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    sql = ORACLES["html_to_text_pages"].replace("from pages", f"from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(tuple(r) for r in QUERIES["html_to_text_pages"](spark, str(tmp_path)).collect()) == sorted(duckdb.sql(sql).fetchall())


def test_hashes_of_many_shingles_are_those_of_each():
    shingles = ["", "a", "é🙂", "\ud800x", *(f"{i:05}" for i in range(300))]
    for n in (128, 7, 1001):
        assert dedup.hashes_of(shingles, n).tolist() == [dedup.shingle_hashes(g, n).tolist() for g in shingles]
    assert dedup.hashes_of([], 4).shape == (0, 4)


def test_a_worker_hashes_a_shingle_once(monkeypatch):
    made, hashes_of = [], dedup.hashes_of
    monkeypatch.setattr(dedup, "hashes_of", lambda some, n: made.extend(some) or hashes_of(some, n))
    monkeypatch.setattr(dedup, "REMEMBERED", 60)
    monkeypatch.setattr(dedup, "_hashed", {})
    texts = ["abcdefgh" * 3, "abcdefgh" * 3, "the quick brown fox", "".join(chr(97 + i % 23) + str(i) for i in range(90)), "", "abc", "abcdefgh" * 3]
    assert [dedup.least_hashes(dedup.shingles_of(t)).tolist() for t in texts] == [signature(t) for t in texts]
    assert all(made.count(g) == 1 for g in dedup.shingles_of(texts[0]))


def test_pairs_by_shingles_in_small_cells_and_groups(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PROBED", 4_000)
    monkeypatch.setattr(dedup, "CELL", 32_000)
    monkeypatch.setattr(dedup, "MANY", 3)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcde") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(60)]
    texts += [t[rng.randrange(9) :] + " x" * rng.randrange(2) for t in texts] + [" ".join(texts), " ".join(texts[5:30]), "ab", "abcde", ""]
    texts = sorted({" ".join(t.split()) for t in texts})
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    sets = [dedup.shingles_of(t) for t in texts]
    overlap = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.95 * min(len(sets[i]), len(sets[j]))}
    found = dedup.overlap_candidates(rows)
    assert len(overlap) > 150 and overlap <= {tuple(r) for r in found.collect()}
    left = [tuple(r) for r in dedup.verified(found, rows).collect()]
    assert len(left) == len(set(left)) and overlap <= set(left)
    near = lambda x, y: 2 * min(len(x), len(y)) >= 0.95 * (len(x) + len(y))
    assert all(near(texts[i], texts[j]) for i, j in set(left) - overlap)


def test_sets_of_shingles_are_not_shuffled(spark):
    rows = spark.createDataFrame([(0, "a text of some words"), (1, "a text of some words more")], "id long, norm string")
    pairs = spark.createDataFrame([(0, 1, 0.9)], "a long, b long, similarity double")
    assert "array_distinct" not in dedup.text_similarity(pairs, rows)._jdf.queryExecution().optimizedPlan().toString()


def test_hits_in_steps_of_few_queries(spark, monkeypatch):
    rng = random.Random(3)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(90)], "vec_id long, embedding array<double>").repartition(3).cache()
    found = lambda: sorted(tuple(r) for r in retrieval.vector_topk(rows, F.col("vec_id") % 2 == 0, k=5).collect())
    whole = found()
    monkeypatch.setattr(retrieval, "ASKED", 7)
    assert len(whole) == 45 * 5 and found() == whole


def test_long_texts_of_one_vocabulary_are_no_candidates(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=1_500)) for _ in range(30)]
    texts += [texts[0][:-40] + "the end", "".join(rng.choice("abc") for _ in range(100_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    assert [tuple(r) for r in dedup.ratio_candidates(rows).collect()] == [(0, 30)]
    assert [tuple(r) for r in dedup.overlap_candidates(rows).collect()] == [(0, 30)]


def test_ratio_candidates_of_all_lengths_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 7)
    rng, texts = random.Random(9), set()
    for n in (1, 2, 4, 7, 12, 20, 28, 33, 60, 118, 125, 300):
        for _ in range(5):
            base = [rng.choice("abcde ") for _ in range(n)]
            for _ in range(4):
                texts.add("".join(base).strip())
                base[rng.randrange(n)] = rng.choice(["", "x", "ab"])
    texts = sorted(texts - {""})
    found = [tuple(r) for r in dedup.ratio_candidates(spark.createDataFrame(list(enumerate(texts)), "id long, norm string")).collect()]
    near = lambda a, b: 2 * min(len(a), len(b)) >= 0.95 * (len(a) + len(b)) and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.95
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if near(texts[i], texts[j])}
    assert len(found) == len(set(found)) and len(want) > 20 and want <= set(found)


def test_matching_blocks_are_those_of_difflib(monkeypatch):
    rng = random.Random(11)
    for places in (0, 40, 1024):
        monkeypatch.setattr(dedup, "PLACES", places)
        for _ in range(120):
            alphabet = rng.choice(["ab", "abcdefgh ", "etaoin shrdlu" * 9 + "bcfgjkmpqvwxyz.,", "".join(map(chr, range(32, 900)))])
            x = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 120, 199, 200, 600])))
            cut = rng.randrange(len(x) + 1)
            y = rng.choice([x[cut:] + x[:cut], x[:cut] + rng.choice(alphabet) + x[cut + 2 :], "".join(rng.choice(alphabet) for _ in range(250))])
            want = sum(b.size for b in SequenceMatcher(None, x, y).get_matching_blocks())
            assert dedup.matched_points(x, y) == want and dedup.matched_points(x, y, want) == want and dedup.matched_points(x, y, want + 1) <= want


def test_signatures_are_whole_only_for_pairs_that_the_first_places_leave_open(spark, monkeypatch):
    made, plain = [], dedup.signatures
    monkeypatch.setattr(dedup, "signatures", lambda rows, permutations=dedup.PERMUTATIONS, k=dedup.SHINGLE: made.append((permutations, rows.count())) or plain(rows, permutations, k))
    rng = random.Random(4)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [*("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(20)), base, base[:1500] + "x" + base[1500:], base + "y" * 3]
    rows = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "id long, norm string, n long")
    edges = {(r["a"], r["b"]) for r in dedup.similar_edges(rows).collect()}
    assert edges == {(20, 21), (20, 22), (21, 22)}
    assert all(n <= 3 for permutations, n in made if permutations == dedup.PERMUTATIONS) and any(permutations < dedup.PERMUTATIONS for permutations, _ in made)


def test_blocks_of_texts_meet_without_being_dealt_out_again(spark, monkeypatch):
    for name, n in (("PROBED", 2_000), ("CELL", 4_000), ("BLOCK", 3)):
        monkeypatch.setattr(dedup, name, n)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(12)]
    texts += [t[:-1] for t in texts[:4]]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    for found in (dedup.overlap_candidates(rows), dedup.ratio_candidates(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert sorted(tuple(r) for r in found.collect()) == [(i, i + 12) for i in range(4)]


def test_texts_that_share_rare_shingles_alone_are_no_candidates(spark):
    rng = random.Random(6)
    common, rare = (["".join(rng.choice(letters) for _ in range(6)) for _ in range(300)] for letters in ("abcdefg", "stuvwxyz"))
    texts = [" ".join(rng.sample(common, 100)) for _ in range(40)]
    texts += [" ".join([*rare[:30], *rng.sample(common, 100)]), " ".join([*rare[:30], *rng.sample(common, 120)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    assert not dedup.overlap_candidates(rows).collect()
    for n in (0, 1, 40, 5000):
        grams = dedup.distinct(dedup.run_hashes("".join(rng.choice("abcdefgh ") for _ in range(n)), 5))
        some = grams if len(grams) <= dedup.ALL_MARKED else grams[grams < 1 << 63]
        assert dedup._marked(dedup._marks(grams)).tolist() == sorted({int(g) % dedup.MARKED_PLACES for g in some})


def test_pairs_that_reach_no_measure_are_no_candidates(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    base = rng.choices(words, k=450)
    near = [w if i % 12 else "eta" for i, w in enumerate(base)]
    texts = [" ".join(base), " ".join(near), " ".join(base[:-1]), " ".join(rng.choices(words, k=450))]
    measures = {(a, b): alike(texts[a], texts[b]) + alike(texts[b], texts[a]) for a in range(4) for b in range(a + 1, 4)}
    want = {p for p, m in measures.items() if max(m) >= 0.95}
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, norm string")
    assert {tuple(r)[:2] for r in dedup.candidate_pairs(rows).collect()} == want == {(0, 2)}
    assert (0, 1) in {tuple(r) for r in dedup.ratio_candidates(rows).collect()}


def test_sets_of_pairs_are_counted_where_they_are_verified(spark, monkeypatch):
    monkeypatch.delattr(dedup, "with_shared")
    texts = likely_texts()
    found = dedup.shingle_similar(spark.createDataFrame(list(enumerate(texts)), "id long, norm string")).collect()
    assert found and all((r["similarity"], r["jaccard"], r["overlap"]) == tuple(round(x, 6) if i else x for i, x in enumerate(alike(texts[r["a"]], texts[r["b"]])[:3])) for r in found)


def test_more_shingles_are_remembered_of_fewer_permutations(monkeypatch):
    made, hashes_of = [], dedup.hashes_of
    monkeypatch.setattr(dedup, "hashes_of", lambda some, n: made.extend(some) or hashes_of(some, n))
    monkeypatch.setattr(dedup, "REMEMBERED", 12)
    monkeypatch.setattr(dedup, "_hashed", {})
    texts = ["".join(chr(97 + i % 23) + str(i) for i in range(60)), "é🙂 and some", None, "", "abc"]
    for _ in range(2):
        assert [x[:8] for x in dedup.least_of_each(texts, 8).tolist()] == [signature(t or "")[:8] for t in texts]
    assert len(made) == len(set(made)) == len(set().union(*map(dedup.shingles_of, texts)))


def test_of_a_long_text_only_rare_code_points_are_gone_through():
    class Text(str):
        read = 0

        def __getitem__(self, at):
            Text.read += not isinstance(at, slice)
            return super().__getitem__(at)

        def __iter__(self):
            Text.read += len(self)
            return super().__iter__()

    rng = random.Random(12)
    long = Text("".join(rng.choice("etaoinshr ") if i % 200 else "x" for i in range(20_000)))
    for short in ("", str(long)[700:900], "x" * 50, "".join(map(chr, range(0xD7F0, 0xD810))) + "\U0010ffffx"):
        for a, b in ((short, long), (long, short)):
            assert dedup.matched_points(a, b) == sum(x.size for x in SequenceMatcher(None, str(a), str(b)).get_matching_blocks())
    assert 0 < Text.read < 3_000


def test_runs_of_different_texts_have_different_hashes(monkeypatch):
    calls, plain = [], dedup._longest_by_place
    monkeypatch.setattr(dedup, "_longest_by_place", lambda a, places, own, b_at, b_end: calls.append(len(own)) or plain(a, places, own, b_at, b_end))
    rng = random.Random(13)
    long, short = ("".join(rng.choice("etaoinshr ") for _ in range(n)) for n in (20_000, 150))
    assert dedup.matched_points(long, short) == sum(x.size for x in SequenceMatcher(None, long, short).get_matching_blocks())
    assert max(calls, default=0) <= dedup.PLACES
