"""Workflows, sinks, file helpers and joins of deltas against plain versions."""

import hashlib
import json
import random

from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import dedup, docmap, ingestion, layout, reports, retrieval
from scriptorium.plans import workflows
from scriptorium.sources import files, sinks


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_first_of_each_with_null_and_repeated_ids(spark):
    rows = [(7, "A  b"), (7, "c"), (3, "a b"), (None, "d"), (None, "D"), (None, None), (9, ""), (3, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in dedup.first_of_each(docs).collect()]
    assert sorted(found, key=str) == sorted([(3, "a b"), (7, "c"), (None, found[[x for _, x in found].index("d")][1] if "d" in [x for _, x in found] else "D"), (9, "")], key=str)
    assert sorted((r["id"], r["n"], r["norm"]) for r in dedup.representatives(docs.where("doc_id is not null")).collect()) == [(3, 3, "a b"), (7, 1, "c"), (9, 1, "")]


def test_topk_ranks_ties_by_id_and_takes_any_length(spark):
    rows = [(i, [1.0, 2.0]) for i in range(100, 0, -1)] + [(0, [1.0, 2.0]), (200, [1.0, 0.0, 0.0]), (201, [2.0, 0.0, 0.0]), (202, [None, 1.0]), (203, [0.0, 0.0]), (204, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    found = retrieval.vector_topk(table, F.col("vec_id").isin(0, 200), 3).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 1.0), (200, 1, 201, 1.0)]


def test_fallbacks_try_the_next_model_and_stop_at_fatal_errors(spark):
    def complete(model, prompt):
        if model == "a-8k" and "slow" in prompt:
            raise RuntimeError("Read timed out")
        if "bad" in prompt:
            raise RuntimeError("bad request")
        return f"{model}:{len(prompt)}"

    rows = spark.createDataFrame([(1, "fine"), (2, "slow one"), (3, "bad one"), (4, "x" * 100_000)], "doc_id long, prompt string")
    found = {r["doc_id"]: r for r in workflows.with_fallbacks(rows, ["a-8k", "b-8k"], complete).collect()}
    assert (found[1]["answer"], found[2]["answer"]) == ("a-8k:4", "b-8k:8")
    assert found[3]["answer"] is None and found[3]["error"] == "bad request" and found[3]["model"] is None
    assert 256 <= int(found[4]["answer"].split(":")[1]) < 100_000


def test_memory_goes_from_chunk_to_chunk(spark):
    def extract(body, history):
        if body == "broken":
            return json.loads("{")
        if body == "fails":
            raise RuntimeError("no")
        return {"facts": [body], "context": history + "|" + body}

    rows = [(d, i, b) for d in (1, 2) for i, b in enumerate(["a", "broken", "fails", "b"])]
    found = workflows.remembered(spark.createDataFrame(rows, "doc_id long, chunk int, text string").repartition(3), "doc_id", "chunk", "text", extract).orderBy("doc_id", "chunk").collect()
    broken = "|a\n\nbroken... [Compressione Fallita]"
    assert [(r["facts"], r["history"]) for r in found[:4]] == [(["a"], "|a"), ([], broken), ([], broken), (["b"], broken + "|b")]
    assert len(found) == 8


def test_reduction_by_groups_where_a_prompt_would_be_too_long(spark):
    rows = [(1, i, f"t{i}") for i in range(12)] + [(2, 0, "u")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk int, text string")
    reply = lambda t, i: json.dumps({"facts": [{"claim": sha(t), "confidence": "low", "section": "?"}], "entities": [], "gaps_vs_sot": [], "open_questions": [], "parse_error": True, "chunk_index": i}, separators=(",", ":"))
    one = [reply(f"t{i}", i) for i in range(12)]
    whole = {r["doc_id"]: r["answer"] for r in workflows.refactored(chunks, "doc_id", "chunk", "text", 10_000).collect()}
    assert whole == {1: sha("\n".join(one)), 2: sha(reply("u", 0))}
    small = {r["doc_id"]: r["answer"] for r in workflows.refactored(chunks, "doc_id", "chunk", "text", 100).collect()}
    assert small == {1: sha("\n".join(sha("\n".join(one[k : k + 5])) for k in range(0, 12, 5))), 2: sha(reply("u", 0))}


def test_steps_are_tried_again_and_stop_or_skip(spark):
    calls = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id long, text string")

    def step(rows):
        def complete(prompt):
            calls.add(1)
            if "bad" in prompt:
                raise RuntimeError("no")
            return prompt.split("\n")[-1] + "!"

        return workflows.single_call(rows, 1000, "task", complete)

    stop = {r["doc_id"]: (r["text"], r["error"]) for r in workflows.retried(docs, [step, step], 1, "stop").collect()}
    assert stop == {1: ("good!!", None), 2: (None, "no")}
    skip = {r["doc_id"]: r["text"] for r in workflows.retried(docs, [step, step], 1, "skip").collect()}
    assert skip == {1: "good!!", 2: "bad"}


def test_rounds_end_when_nothing_waits(spark):
    state = spark.createDataFrame([(k, "pending" if k < 7 else "completed", k) for k in range(9)], "key long, status string, ts int")
    there = state.where("key <> 4").select("key")
    found = {r["key"]: r["status"] for r in workflows.run_rounds(state, there, 3, ["ts"]).collect()}
    assert found == {k: "failed" if k == 4 else "completed" for k in range(9)}


def bundle(canon, most):
    """The canon's text, part by part."""
    parts = [(t, r, x) for t, r, x in canon if x]
    share, total, blocks = max(2000, most // max(len(parts), 1)), 0, []
    for _, rel, text in sorted(parts, key=lambda p: (p[0], p[1].lower(), p[1])):
        if len(text) > share:
            text = text[: share // 2] + f"\n\n_[… {rel} troncato: {len(text) - share} caratteri omessi …]_\n\n" + text[-(share // 2) :]
        if total + len(text) > most:
            if most - total <= 500:
                break
            text = text[: most - total]
        blocks.append(f"### SOT: {rel}\n\n{text}")
        total += len(text)
    return "\n\n---\n\n".join(blocks) or "_Nessun documento SOT caricato._"


def test_the_canon_is_cut_to_equal_shares(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 5, 9, 30):
        canon = [(rng.randint(1, 2), rng.choice("aBc") + str(i), "".join(rng.choice("xyz \n") for _ in range(rng.choice([0, 3, 400, 1999, 2001, 12_001])))) for i in range(n)]
        for most in (900, 14_000):
            assert retrieval.canon_bundle(spark.createDataFrame(canon, "tier int, rel string, text string"), most) == bundle(canon, most)


def test_gap_reports_hold_the_canon_and_all_chunks(spark):
    docs = spark.createDataFrame([(1, "short"), (2, "## A\n\n" + "word " * 300 + "\n\n## B\n\n" + "light " * 200)], "doc_id long, text string")
    canon = [(1, "a", "x" * 12_001), (2, "b", "second")]
    rag = spark.createDataFrame([(1, "## found")], "doc_id long, context string")
    found = {r["doc_id"]: r for r in workflows.gap_report(docs, spark.createDataFrame(canon, "tier int, rel string, text string"), 400, rag=rag).collect()}
    end = "Report **ricco e contestualizzato** per allegarlo a Claude/GPT e aggiornare LAST DOCS.\nRispetta la struttura del system prompt (Sintesi, GAP numerati, Azioni redazione, Handoff IA)."
    asked = f"# Documentazione SOT (Source of Truth)\n\n{bundle(canon, 14_000)}\n\n\n## found\n\n---\n\n# Documento grezzo da confrontare\n\n**File:** `1 (sezione: full, chunk 1/1)`\n\n> **Ambito (chunking):** Parte **1/1** del file (`full`). Analizza **solo** il testo sotto; altre parti = altre passate LLM.\n\nshort\n\n---\n\n{end}"
    assert "caratteri omessi" in asked and "### SOT: b\n\nsecond" in asked
    assert found[1]["n_parts"] == 1 and sha(asked) in found[1]["report"] and found[2]["n_parts"] == 2


def test_entries_are_those_of_a_loop(spark):
    rng = random.Random(9)
    for n, letters in ((0, 2), (24, 3)):
        entries = [(10 * i + rng.randint(0, 3), rng.choice("abcdefgh") + str(rng.randrange(letters)), rng.choice("STUVWX") + str(rng.randrange(letters)), "pending") for i in range(n)]
        new = [(rng.choice("abcdefghijklmnop") + str(rng.randrange(letters)), rng.choice("STUVWXYZ") + str(rng.randrange(letters)), "completed") for _ in range(20 * letters)]
        now, base = [list(e) for e in entries], max([e[0] for e in entries], default=-1)
        for k, (name, md5, status) in enumerate(sorted(set(new)), 1):
            for e in now:
                if e[1] == name or e[2] == md5:
                    e[1:] = [name, md5, status]
                    break
            else:
                now.append([base + k, name, md5, status])
        found = ingestion.registered_entries(spark.createDataFrame(entries, "place long, name string, md5 string, status string"), spark.createDataFrame(new, "name string, md5 string, status string"))
        assert sorted(map(list, found.collect())) == sorted(now)


def test_pages_become_chunks_and_memory(spark):
    blocks = [(1, 0, 1, 0.0, 0.0, "text", "## Page 1", None), (1, 0, 2, 1.0, 0.0, "image", None, 5), (1, 0, 3, 2.0, 0.0, "text", " tail ", None), (1, 1, 4, 0.0, 0.0, "image", None, 5), (1, 1, 5, 0.0, 1.0, "image", None, None)]
    table = spark.createDataFrame(blocks, "doc long, page int, block int, y0 double, x0 double, kind string, text string, xref int")
    assert [r["body"] for r in layout.numbered_pages(table).orderBy("page").collect()] == ["## Page 1\n\n[IMG_REF:img_001]\n\ntail", "[IMG_REF:img_002]\n\n[IMG_REF:img_003]"]
    chunks, memory = workflows.extracted_and_remembered(table, 50)
    assert {a for r in chunks.collect() for a in r["assets"]} == {"img_001", "img_002", "img_003"} and memory.count() == chunks.count()
    empty = layout.assembled(spark.createDataFrame([(1, 0, None)], "doc long, page int, body string"), F.lit("x.pdf")).first()["text"]
    assert empty.startswith("# Raw extraction — x.pdf\n") and "nessun testo" in empty


def test_images_that_no_block_shows_come_last(spark):
    blocks = [(1, 0, 1, 0.0, 0.0, "text", "top", None), (1, 0, 2, 1.0, 0.0, "image", None, 5), (1, 1, 3, 0.0, 0.0, "image", None, None)]
    table = spark.createDataFrame(blocks, "doc long, page int, block int, y0 double, x0 double, kind string, text string, xref int")
    images = spark.createDataFrame([(1, 0, 0, 9), (1, 0, 1, 5), (1, 0, 2, 8), (1, 0, 3, 9), (1, 1, 0, 5), (1, 2, 0, 7), (1, 2, 1, None)], "doc long, page int, ord int, xref int")
    pages = layout.numbered_pages(layout.with_unreferenced(table, images))
    want = ["top\n\n[IMG_REF:img_001]\n\n[IMG_REF:img_002]\n\n[IMG_REF:img_003]", "[IMG_REF:img_004]\n\n[IMG_REF:img_005]", "[IMG_REF:img_006]"]
    assert [r["body"] for r in pages.orderBy("page").collect()] == want
    read = spark.createDataFrame([(1, 0, "scanned"), (1, 1, " \n"), (3, 0, "x")], "doc long, page int, text string")
    bodies = spark.createDataFrame([(1, 0, " a "), (1, 1, "b"), (3, 0, None)], "doc long, page int, body string")
    assert sorted(map(tuple, layout.with_recognised(bodies, read).collect())) == [(1, 0, "a\n\nscanned"), (1, 1, "b"), (3, 0, "x")]


def test_a_report_without_a_key_is_numbered_by_ranges(spark):
    rows = spark.createDataFrame([(i * 7 % 50, f"t{i * 7 % 50}") for i in range(50)], "n int, text string")
    found = reports.general_report(rows, F.lit("head"), "n").orderBy("place").collect()
    assert [(r["place"], r["text"]) for r in found] == [(0, "head"), *[(i + 1, f"t{i}") for i in range(50)]]


def test_a_search_answers_if_it_has_a_hit(spark):
    assert retrieval.answers(spark.range(3)) and not retrieval.answers(spark.range(0))


def test_roles_choose_the_canon_of_a_project(spark):
    files = [("p", 1, "b", "raw one", None), ("p", 2, "a", "canon text", "SOT"), ("p", 3, "c", "raw two", "Raw"), ("q", 4, "d", "other", "SOT"), ("p", 5, "e", None, None)]
    rows = spark.createDataFrame(files, "project string, doc_id long, rel string, text string, role string")
    seen = {r["doc_id"]: r["report"] for r in workflows.project_gap(rows, "p", 400, complete=lambda p: f"canon text in it: {'canon text' in p}, other: {'other' in p}").collect()}
    assert sorted(seen) == [1, 3] and all("canon text in it: True, other: False" in x for x in seen.values())
    assert [r["doc_id"] for r in workflows.project_gap(rows, "p", 400, limit=1).collect()] == [1]


def test_a_document_is_read_with_two_condensates_and_ends_at_a_failure(spark):
    chunks = [(1, i, "l", f"text {i}") for i in range(4)] + [(2, 0, None, None), (2, 1, "bad", "x"), (2, 2, "l", "never")]
    asked = {}

    def complete(prompt):
        if "`bad`" in prompt:
            raise RuntimeError("no answer")
        return f"## CONDENSATO\n{'long enough a condensate of ' + sha(prompt)[:8]}\n## End" if "text 1" in prompt else sha(prompt)

    recent, want = [], []
    for i in range(4):
        before = "\n".join(f"### Blocco precedente -{len(recent[-2:]) - k}\n{c}" for k, c in enumerate(recent[-2:]))
        context = f"\n---\n**Contesto rolling (ultimi blocchi analizzati):**\n{before}\n---\n\n" if recent else ""
        asked = complete(f"# Documento: `1`\n# Frammento {i + 1} di 4: `l`\n{context}## Testo del frammento\n\ntext {i}")
        recent.append("long enough a condensate of " + asked.split("condensate of ")[1][:8] if "CONDENSATO" in asked else sha(asked))
        want.append((1, i, asked, recent[-1], None))
    rows = spark.createDataFrame(chunks, "doc long, n int, label string, text string")
    found = sorted(map(tuple, workflows.sliding_window(rows, "doc", "n", "label", "text", complete).collect()))
    assert found[:4] == want and [(r[1], r[4]) for r in found[4:]] == [(0, None), (1, "no answer")]
    refused = workflows.sliding_window(rows, "doc", "n", "label", "text", most_chars=5).collect()
    assert len(refused) == 2 and all(r["error"].startswith("prompt of ") and r["analysis"] is None for r in refused)


def test_images_are_described_and_failures_wait(spark):
    images = spark.createDataFrame([(1, "a", False, ["c1", "c2"]), (1, "b", True, ["c1"]), (1, "bad", None, ["c3"]), (2, "e", False, None)], "doc long, id string, vision_processed boolean, linked_chunks array<string>")
    chunks = spark.createDataFrame([(1, "c1", "one"), (1, "c2", "two"), (1, "c3", "fail"), (2, "c1", "other")], "doc long, id string, text string")
    def complete(prompt):
        if "fail" in prompt:
            raise RuntimeError("no")
        return prompt[:8]
    marked, memory = workflows.enriched(images, chunks, "doc", complete)
    assert {(r["doc"], r["id"]): r["vision_processed"] for r in marked.collect()} == {(1, "a"): True, (1, "b"): True, (1, "bad"): False, (2, "e"): True}
    assert {r["doc"]: (r["bucket"], [json.loads(x) for x in r["items"]]) for r in memory.collect()} == {1: ("vision_insights", [{"image_id": "a", "insight": "one\ntwo\n"}]), 2: ("vision_insights", [{"image_id": "e", "insight": "\nSpiega "}])}


def test_sinks_replace_ignore_and_index(spark, tmp_path):
    one = spark.createDataFrame([("w", "a.md", "body"), ("v", "b.md", "é")], "workflow string, path string, body string")
    sinks.written(one, f"{tmp_path}/t")
    sinks.written(one.limit(0), f"{tmp_path}/t", replace=False)
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    for _ in range(2):
        sinks.saved_outputs(one, f"{tmp_path}/out", f"{tmp_path}/index")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    assert sorted(r["size_bytes"] for r in sinks.newest_outputs(spark, f"{tmp_path}/index", 3).collect())[-1] == 4 and sinks.newest_outputs(spark, f"{tmp_path}/index", 3).count() == 3


def test_files_are_picked_by_folder_glob_and_key(spark, tmp_path):
    for name, body in {"a.md": "x", "b.PDF": "y", ".hidden.md": "z", "sub/c.py": "1\n2", "sub/deep/d.py": "", "log/e.log": "l\xe9g", "docs/f.md": "n", "bad.json": "{", "good.json": '{"a": [1]}'}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [r["name"] for r in files.top_files(spark, str(tmp_path)).collect()] == ["a.md", "b.PDF"]
    scan = files.scan(spark, str(tmp_path), [".py", ".md", ".log", ".json"], 100)
    assert {r["rel"] for r in scan.collect()} == {"a.md", "sub/c.py", "log/e.log", "bad.json", "good.json"}
    assert {r["rel"] for r in files.selected(scan, ["sub/*.py", "**/*.log"]).collect()} == {"sub/c.py", "log/e.log"}
    found = {r["rel"]: (r["text"], r["status"]) for r in files.texts(scan.where("type <> '.py'")).collect()}
    assert found["good.json"] == ('{ "a": [ 1 ] }', "ok") and found["bad.json"][1] == "converter_error" and found["log/e.log"][0] == "lég"
    assert [r["section"] for r in files.dump(scan.where("rel = 'a.md'")).collect()] == ["## a.md\n\n```\nx\n```\n"]
    keys = scan.select("rel", files.rel_key(F.col("path"), str(tmp_path)).alias("in"), files.rel_key(F.col("path"), "/elsewhere").alias("out")).collect()
    assert all(r["in"] == r["rel"] and r["out"] == r["rel"].split("/")[-1] for r in keys)
    counts = scan.select("rel", files.code_lines(files.decoded(F.col("content"))).alias("n")).where("rel = 'sub/c.py'").first()
    assert counts["n"] == 2


def test_store_keys_contain_names(spark):
    rels = ["src/R&D notes.md", "a/b/plan-1.txt", "x/none.md", "c.md", "deep/ünï çode.md", "q/___.md", "docs/___.md", "w/+-+.txt", "w/=.txt", "k/doc 17.md", "k/doc 1.md", "k/n 7.md"]
    keys = ["custom\\R&D notes.md", "store/my_PLAN_1_v2.json", "abc.md", "zz/Ünï-Çode.md-77.json", "custom/q/___.md", "m/xdoc_17b.json", "m/+_+"]
    norm = lambda s: s.lower().replace("\\", "/").replace("&", "and").replace(" ", "_").replace("-", "_")
    expected = set()
    for rel in rels:
        tail = rel.split("/")[-1]
        stem = norm(tail.rsplit(".", 1)[0])
        if any(rel in k.replace("\\", "/") or tail in k.replace("\\", "/") or (stem and stem in norm(k)) for k in keys):
            expected.add(rel)
    found = ingestion.in_store(spark.createDataFrame([(r,) for r in rels], "rel string"), spark.createDataFrame([(k,) for k in keys], "key string"))
    assert {r["rel"] for r in found.collect()} == expected and len(expected) == 9


def test_forced_delta_forgets_the_cache_but_not_the_store(spark):
    rows = spark.createDataFrame([("a.md", "1"), ("b.md", "2"), ("c.md", "3")], "rel string, md5 string")
    cache = spark.createDataFrame([("a.md", "there", "1"), ("b.md", "b", "old")], "rel string, location string, md5 string")
    keys = spark.createDataFrame([("b.md",)], "key string")
    of = lambda **how: {r["rel"]: (r["action"], r["location"]) for r in ingestion.remote_delta(rows, cache, keys, **how).collect()}
    assert of() == {"a.md": ("cached", "there"), "b.md": ("remote", "b"), "c.md": ("pending", "manual-ui")}
    assert of(force=True, manual=False) == {"a.md": ("upload", None), "b.md": ("remote", "remote-existing"), "c.md": ("upload", None)}


def test_chunks_without_ids_are_refused(spark):
    table = docmap.filled(spark.createDataFrame([], "doc long, turn int, id string"), "chunks")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, " ")], "doc long, turn int, id string")
    try:
        docmap.replaced(table, new, "doc", "turn").collect()
    except Exception as e:  # noqa: BLE001
        assert "needs an id" in str(e)
    else:
        raise AssertionError("a chunk without an id was taken")


def test_payloads_of_any_depth(spark):
    deep = {"a": 1}
    for _ in range(14):
        deep = {"in": deep}
    rows = [json.dumps({"token": "x", "ok": [1, "Bearer abc", "a" * 30, "a b"], "long": list(range(300))}), json.dumps(deep), "Bearer zzz", None, "{broken"]
    found = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, raw string").orderBy("i").select(text.redacted_json(F.col("raw"))).collect()]
    first = json.loads(found[0])
    assert first["token"] == "[REDACTED]" and first["ok"] == [1, "[REDACTED]", "[REDACTED]", "a b"] and len(first["long"]) == 200
    assert "[max depth]" in found[1] and found[2:] == ["[REDACTED]", None, "{broken"]


def test_bpe_counts_match_the_library(spark):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    from tiktoken.load import load_tiktoken_bpe

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
    rows = [(0, "Ciao, è un testo."), (1, ""), (2, None)]
    count = text.bpe_counter(path, public_tokenizers.PATTERN, spark)
    found = [r["n"] for r in spark.createDataFrame(rows, "i int, t string").orderBy("i").select(count(F.col("t")).alias("n")).collect()]
    assert found == [len(own.encode_ordinary(rows[0][1])), 0, None]


def test_pages_are_ordered_by_more_tasks_as_blocks_grow(spark, monkeypatch):
    rows = [(doc, page, b, float(b % 3), 0.0, "image" if b % 2 else "text", f"t{b}", b % 4 if b % 3 else None) for doc in range(20) for page in range(2) for b in range(5)]
    table = spark.createDataFrame(rows, "doc long, page int, block long, y0 double, x0 double, kind string, text string, xref long")
    whole = sorted(tuple(r) for r in layout.numbered_pages(table).collect())
    monkeypatch.setattr(layout, "BLOCKS", 10)
    spread = layout.numbered_pages(table)
    assert spread.rdd.getNumPartitions() == 20 and sorted(tuple(r) for r in spread.collect()) == whole and len(whole) == 40


def test_a_digest_of_many_named_entries_is_registered_at_once(spark, monkeypatch):
    written, plain = [], ingestion.saved
    monkeypatch.setattr(ingestion, "saved", lambda df: written.append(1) or plain(df))
    entries = [(i, f"f{i:02d}", "same", "pending") for i in range(0, 40, 2)]
    new = [(f"f{i:02d}", "same", "done") for i in range(0, 40, 3)]
    there = [list(e) for e in entries]
    for k, (name, md5, status) in enumerate(sorted(new)):
        at = next((e for e in there if name == e[1] or md5 == e[2]), None)
        if at is None:
            there.append([38 + k + 1, name, md5, status])
        else:
            at[1:] = name, md5, status
    found = ingestion.registered_entries(spark.createDataFrame(entries, "place long, name string, md5 string, status string"), spark.createDataFrame(new, "name string, md5 string, status string"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, there))
    assert len(written) <= 3


def test_images_that_no_block_shows_are_dealt_out_with_the_blocks(spark, monkeypatch):
    monkeypatch.setattr(layout, "BLOCKS", 20)
    table = spark.createDataFrame([(d, 0, b, float(b), 0.0, "image" if b % 2 else "text", f"t{b}", b if b % 2 else None) for d in range(60) for b in range(4)], "doc long, page int, block long, y0 double, x0 double, kind string, text string, xref int")
    images = spark.createDataFrame([(d, 0, x * 10 + y, x) for d in range(60) for x in (1, 2, 7) for y in (1, 0)], "doc long, page int, ord long, xref int")
    pages = layout.numbered_pages(layout.with_unreferenced(table, images), dealt_out=True)
    mark = lambda n: f"[IMG_REF:img_{n:03d}]"
    assert {r["body"] for r in pages.collect()} == {"\n\n".join(["t0", mark(1), "t2", mark(2), mark(3), mark(4)])} and pages.count() == 60
    assert pages.rdd.getNumPartitions() == 30 and "Join" not in pages._jdf.queryExecution().optimizedPlan().toString()
