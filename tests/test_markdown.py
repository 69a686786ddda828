"""Chunks of Markdown against plain versions in Python."""

import random
import re

from scriptorium.operators import chunking, overlap, semantic

SENTENCE = r"(?<=[.!?…])\s+(?=[A-ZÀ-ÿ0-9\"'`(])"


def tokens(text):
    return max(1, len(text) // 4)


def samples():
    rng = random.Random(4)
    words = "river stone Water light tree. House green! walk paper 7 seed cloud? Hill".split()
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    fence = lambda: "```py\n# not a heading\n\n" + line(12) + "\n```"
    table = "| a | b |\n|---|:-:|\n| 1 | 2 |\n| 3 | 4 |"
    out = ["", "plain text only", "# Only\n", "```\nopen fence\n# x\n", "| a |\n|---|\nno rows", "a\n| h |\n|--|\n| 1 |\nb", "## A\n\n```x```\n\n## B\n\nsee A here\n"]
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(2, 14)):
            kind = rng.random()
            if kind < 0.35:
                parts.append("#" * rng.randint(1, 4) + f" Head {rng.randint(1, 5)}")
            elif kind < 0.55:
                parts.append(fence())
            elif kind < 0.65:
                parts.append(table)
            else:
                parts.append("\n".join(line(rng.randint(3, 60)) for _ in range(rng.randint(1, 3))))
        out.append("\n\n".join(parts))
    return list(enumerate(out))


def plain_sections(text):
    """(kind, heading, text) by scanning lines, fences marked before."""
    masked, blocks = [], []
    for i, part in enumerate(re.split(r"(?s)(```.*?```)", text)):
        if i % 2:
            blocks.append(part)
            masked.append(f"\n\x00{len(blocks) - 1}\x00\n")
        else:
            masked.append(part)
    rows, heading, buffer = [], "", []

    def flush():
        own, kinds = [], []
        lines, i = list(buffer), 0
        while i < len(lines):
            bar = lambda k: k < len(lines) and re.fullmatch(r"\|.+\|", lines[k])
            if m := re.fullmatch("\x00(\\d+)\x00", lines[i]):
                own.append(blocks[int(m.group(1))]), kinds.append("code_fence")
            elif bar(i) and bar(i + 1) and re.fullmatch(r"\|[-:\s|]+\|", lines[i + 1]) and bar(i + 2):
                start = i
                while bar(i + 1):
                    i += 1
                own.append("\n".join(lines[start : i + 1])), kinds.append("table")
            else:
                own.append(lines[i])
                if lines[i].strip():
                    kinds.append("text")
            i += 1
        body = "\n".join(own).strip()
        if body:
            rows.append((kinds[0] if len(kinds) == 1 and kinds[0] != "text" else "text", heading, body))
        buffer.clear()

    for line in "".join(masked).split("\n"):
        if m := re.match(r"#{1,3}\s+(.+)$", line):
            flush()
            heading = m.group(1).strip()
            rows.append(("heading", heading, line))
        else:
            buffer.append(line)
    flush()
    return rows


def plain_chunks(text, most, least):
    sections = plain_sections(text)
    groups, total = [], 0
    for i, (_, heading, body) in enumerate(sections):
        if groups and total + tokens(body) > most and total >= least:
            groups.append([i])
            total = (tokens(f"[Contesto: {heading}]\n") if heading else 0) + tokens(body)
        else:
            groups = groups or [[]]
            groups[-1].append(i)
            total += tokens(body)
    out, boundary = [], "paragraph"
    for k, group in enumerate(groups):
        own = [sections[i] for i in group]
        last = groups[k + 1][0] if k + 1 < len(groups) else group[-1]
        boundary = next((kind for kind, _, _ in reversed(own) if kind in ("code_fence", "table")), boundary)
        context = [f"[Contesto: {own[0][1]}]\n"] if k and own[0][1] else []
        whole = "\n".join([*context, *(b for _, _, b in own)]).strip()
        heads = list(dict.fromkeys(h for _, h, _ in sections if h))
        refs = [h for h in heads if h.lower() in whole.lower() and h not in whole[: len(h) + 2]]
        out.append((k, whole, tokens(whole), boundary, sections[last][1], "```" in whole, any(kind == "table" for kind, _, _ in own), refs))
    return out


def test_semantic_chunks_match_a_plain_version(spark):
    rows = samples()
    docs = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    found = {}
    for r in semantic.markdown_sections(docs).orderBy("doc_id", "section").collect():
        found.setdefault(r["doc_id"], []).append((r["kind"], r["heading"], r["text"]))
    for d, t in rows:
        assert found.get(d, []) == plain_sections(t), t
    for most, least in ((60, 20), (200, 100), (10, 1)):
        chunks = {}
        for r in semantic.semantic_chunks(docs, most, least).orderBy("doc_id", "chunk").collect():
            chunks.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        for d, t in rows:
            assert chunks.get(d, []) == plain_chunks(t, most, least), t


def test_chunks_are_found_again_in_their_text(spark):
    rows = samples()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = dict(rows)
    at = {}
    for r in semantic.located(semantic.semantic_chunks(docs, 60, 20), docs).orderBy("doc_id", "chunk").collect():
        text, start = by[r["doc_id"]], at.get(r["doc_id"], 0)
        prefix = r["text"].find("]\n") + 2 if r["text"].startswith("[Contesto:") and "]\n" in r["text"] else 0
        raw = r["text"][prefix:]
        begin = text.find(raw[:120], start)
        begin = begin if begin >= 0 else text.find(raw[:40].strip(), start)
        begin = begin if begin >= 0 else start
        assert (r["prefix"], r["char_start"], r["char_end"]) == (prefix, begin, min(len(text), begin + len(raw)))
        at[r["doc_id"]] = max(start, r["char_end"])


def plain_fences(text):
    spans, at, begin = [], 0, None
    for line in text.split("\n"):
        if line.strip().startswith("```"):
            if begin is None:
                begin = at
            else:
                spans.append((begin, min(len(text), at + len(line) + 1)))
                begin = None
        at += len(line) + 1
    return spans


def plain_tail(text, most):
    if not text.strip():
        return ""
    begin = 0
    if len(text) > most:
        least, rough, spans = max(0, len(text) - 2 * most), len(text) - most, plain_fences(text)
        free = lambda p: not any(a <= p < b for a, b in spans)

        def boundary(p):
            before = text[least:p]
            return text[p] == "\n" or (re.search(r"\n\s*\n$", before) and not re.match(r"\s*\n", text[p:])) or (re.search(r"[.!?…]\s+$", before) and re.match(r"[A-ZÀ-ÿ0-9\"'`(]", text[p:])) or p in [b for _, b in spans] or p == 0

        good = [p for p in range(least, rough + 1) if free(p) and boundary(p)]
        begin = good[-1] if good else next((b for a, b in spans if a < rough < b), rough)
    part = text[begin:].strip("\n")
    if part.count("```") % 2:
        first, last = part.find("```"), part.rfind("```")
        part = part[first : last + 3] if last > first else part[first:].split("\n", 1)[-1] if "\n" in part[first:] else part[first:]
    return part.strip()


def test_overlap_tails_match_a_plain_version(spark):
    texts = [t for _, t in samples() if t.strip()] + ["x" * 900, "Short. Text here.", "a\n\n\n\nb " * 90, "```\n" + "code line\n" * 90 + "```\nend. After the fence."]
    rows = [(1, i, "t", t) for i, t in enumerate(texts)]
    found = overlap.with_structural_overlap(spark.createDataFrame(rows, "doc_id long, section int, title string, text string"), 250).orderBy("section").collect()
    for i, r in enumerate(found):
        tail = plain_tail(texts[i - 1], 250) if i else ""
        assert (r["overlap"], r["enriched"]) == (len(tail), (overlap.NOTICE + tail + "\n\n" + texts[i]) if tail else texts[i]), texts[i - 1]


def packed(units, most, glue="\n\n"):
    out, total = [], 0
    for u in units:
        if out and total + tokens(u) <= most:
            out[-1].append(u)
            total += tokens(u)
        else:
            out.append([u])
            total = tokens(u)
    return [glue.join(g) for g in out]


def test_safe_boundaries_keep_sentences_and_budgets(spark):
    rng = random.Random(8)
    sentence = lambda n: " ".join(["Water"] + [rng.choice("river stone light".split()) for _ in range(n)]) + "."
    long = " ".join(sentence(9) for _ in range(20))
    text = "\n\n".join([sentence(4), sentence(5), long, sentence(3)])
    docs = spark.createDataFrame([(1, 0, "label", text)], "doc_id long, section int, title string, text string")
    found = [(r["title"], r["text"]) for r in overlap.refined(docs, 60).orderBy("section").collect()]
    parts = packed(re.split(SENTENCE, long), 60)
    expected = [("label", "\n\n".join(text.split("\n\n")[:2])), *(("label" if i == 0 else f"label (part {i})", p) for i, p in enumerate(parts)), ("label (part 1)", text.split("\n\n")[-1])]
    assert found == expected


def test_markdown_chunks_fit_and_lose_nothing(spark):
    rows = samples()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in overlap.markdown_chunks(docs, 80, 20).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["title"], r["text"]))
    for d, t in rows:
        chunks = got[d]
        if tokens(t) <= 80:
            assert chunks == [("full", t)]
        else:
            assert all(tokens(x) <= 80 + x.count("\n\n") for _, x in chunks)  # joints aren't counted
            assert "".join("".join(x.split()) for _, x in chunks) == "".join(t.split())


def test_headings_inside_fences_are_none(spark):
    docs = spark.createDataFrame([(1, "# A\n```\n# no\n## no\n```\n## B\n### C\n# D\n### E")], "doc_id long, text string")
    found = [(r["title"], r["h1"], r["h2"]) for r in chunking.heading_path(docs).orderBy("line").collect()]
    assert found == [("A", "A", ""), ("B", "A", "B"), ("C", "A", "B"), ("D", "D", ""), ("E", "D", "")]
