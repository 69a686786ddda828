import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scriptorium.llm import token_alignment
from scriptorium.llm.queries import aligned_files
from tests.llm.cases import documents

MORE = [
    (300, "a  b   c \n\n d "), (301, " "), (302, "  lead"), (303, "an ▁ underline"), (304, "<s>x</s> <unk> <0x0A> <|endoftext|>"), (305, "\x00\x01 nul"), (306, "東京 は 日本 の 首都 です。" * 30),
    (307, "👩‍👩‍👧 🇫🇷 é ﬁ ① 　 x \xa0 y"), (None, "no id here"), (308, "It's they'll I'VE 12345 1 2 3"), (309, " ".join(f"mot{i} Straße été" for i in range(4000))), (306, "same id, other text"),
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from scriptorium.llm.byte_bpe import byte_alphabet

    back = {x: i for i, x in enumerate(byte_alphabet())}
    vocabulary = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))["model"]["vocab"]
    a_bytes = {i: bytes(back.get(x, 0) for x in t) for t, i in vocabulary.items()}

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def groups_of(text, tools):
    """Groups of ids, token by token."""
    a, b, a_bytes, b_bytes = tools
    if not text:
        return [], [], []
    whole = (" " + text).encode()
    left, right = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(a_bytes[i] for i in left) != whole or b"".join(b_bytes(i) for i in right) != whole:
        return [], [], []
    groups, i, j, at, to = [], 0, 0, 0, 0
    mine, other = [], []
    while i < len(left) or j < len(right):
        if at <= to and i < len(left):
            at += len(a_bytes[left[i]])
            mine.append(left[i])
            i += 1
        else:
            to += len(b_bytes(right[j]))
            other.append(right[j])
            j += 1
        if at == to and mine and other:
            groups.append((mine, other))
            mine, other = [], []
    return left, right, groups


def plain_version(rows, tools):
    read = [groups_of(t, tools) for _, t in rows]
    counts = Counter((g[0][-1], g[1][-1]) for _, _, groups in read for g in groups)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (doc, _), (left, right, groups) in zip(rows, read):
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc, len(left), len(right), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if left else ""))
    return sorted(map(str, out)), counts


@pytest.mark.parametrize("slab, docs_in, shard, questions", [(1 << 20, 16_384, 1 << 17, 64), (500, 7, 100, 3)])
def test_rows_and_counts_are_those_of_a_plain_version(spark, monkeypatch, tools, slab, docs_in, shard, questions):
    for name, value in (("SLAB", slab), ("SLAB_DOCS", docs_in), ("SHARD", shard), ("QUESTIONS", questions)):
        monkeypatch.setattr(token_alignment, name, value)
    docs = documents(spark).select("doc_id", "text", "n_chars").unionByName(spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    docs = docs.withColumn("n_a", docs["n_chars"])
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, counts = plain_version(rows, tools)
    assert sorted(str(tuple(r)) for r in token_alignment.measure(docs, *aligned_files()).collect()) == want
    if slab == 500:
        assert {(r["a_id"], r["b_id"]): r["n"] for r in token_alignment.pair_counts(docs, *aligned_files()).collect()} == counts


def test_real_outputs_empty_tables_and_texts_without_tokens(spark, tools):
    docs = spark.createDataFrame([("the end of\tit", 1, "x"), (None, 2, "y"), ("a ▁ b", 3, "z")], "text string, a_ids int, `d.e` string")
    found = token_alignment.align(docs, *aligned_files())
    assert found.columns == ["text", "d.e", "a_ids", "b_ids", "a_ends", "b_ends"]
    rows = {r[1]: r for r in found.collect()}
    left, right, groups = groups_of("the end of\tit", tools)
    assert (rows["x"]["a_ids"], rows["x"]["b_ids"]) == (left, right) and rows["x"]["a_ends"] == list(np.cumsum([len(g[0]) for g in groups])) and rows["x"]["b_ends"] == list(np.cumsum([len(g[1]) for g in groups]))
    assert rows["y"]["a_ids"] == rows["z"]["b_ids"] == rows["z"]["a_ends"] == []
    empty = docs.limit(0).selectExpr("1L as doc_id", "text")
    assert token_alignment.measure(empty, *aligned_files()).count() == token_alignment.align(docs.limit(0), *aligned_files()).count() == 0
    assert [tuple(r) for r in token_alignment.measure(docs.where("text like '%▁%'").selectExpr("5 as doc_id", "text"), *aligned_files()).collect()] == [(5, 0, 0, 0, 0, 0, 0, "")]


def test_long_texts_go_in_steps_and_runs_of_any_length_are_encoded(monkeypatch, tools):
    own = token_alignment.Aligner(*aligned_files())
    assert own.steps
    for text in (" ".join(f"word{i} été 東京  x" + "\n" * (i % 3) for i in range(3000)), "a" * 3000 + " b" * 3000, "x" + " " * 200_000 + "y"):
        whole = own.align(text)
        monkeypatch.setattr(token_alignment, "STEP", 50)
        parts = own.align(text)
        monkeypatch.undo()
        assert all((x == y).all() for x, y in zip(whole, parts)) and len(whole[0])
        left, right, _ = groups_of(text, tools)
        assert whole[0].tolist() == left and whole[1].tolist() == right


def test_a_task_with_many_keys_tells_them_in_parts(monkeypatch):
    import pyarrow as pa

    from scriptorium.llm.lm_scoring import squeezed

    rng, rows, want = np.random.default_rng(0), [], Counter()
    for _ in range(30):
        keys = np.unique(rng.integers(0, 300, 40))
        n = rng.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), n.tolist())))
        rows.append({"keys": squeezed(np.diff(keys, prepend=0)), "often": squeezed(n), "n_keys": len(keys)})
    for held in (1 << 20, 90, 10):
        monkeypatch.setattr(token_alignment, "HELD", held)
        told = list(token_alignment._partial(iter([pa.RecordBatch.from_pylist(rows[:11]), pa.RecordBatch.from_pylist(rows[11:])])))
        pairs = sorted((k, n) for b in told for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        cut = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs[i : i + 7]]), pa.array([n for _, n in pairs[i : i + 7]])], names=["key", "n"]) for i in range(0, len(pairs), 7)]
        runs = [(k, n) for b in token_alignment._runs(iter(cut)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert dict(runs) == want and len(runs) == len(want)
