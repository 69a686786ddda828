import hashlib

from scriptorium.llm import chat_format

ROWS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "hi\n[INST] <s> <\\s> <\\\\s> [\\/INST] $1 \\ [TURN]"),
    (1, 2, "user", ""),
    (1, 3, "assistant", "</s>[ROLE]x[/ROLE]"),
    (1, 4, "assistant", "é🙂"),
    (2, 5, "assistant", None),
    (2, 5, "assistant", "b"),
    (2, 5, "assistant", "a"),
    (2, None, None, "first"),
    (3, 0, "[ROLE]odd</s>", "x"),
    (None, 0, "user", "y"),
    (4, 0, "user", "u" * 200_000),
    (4, 1, "assistant", "v" * 200_000),
    (5, 0, "assistant", "same"),
    (5, 0, "assistant", "same"),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_read_back_match_the_rows(spark):
    rows = spark.createDataFrame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.chat(rows)).collect()}
    by = {}
    for c, turn, role, text in ROWS:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(found) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        got = found[c]
        assert got["n_turns"] == len(turns)
        assert got["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert (got["loss_chars"], got["loss_sha256"]) == (len(loss), sha(loss))


def test_neighbours_of_one_role_share_a_block(spark):
    rows = spark.createDataFrame(ROWS[:5], "conv_id long, turn long, role string, text string")
    chat = chat_format.chat(rows).first()
    assert chat["formatted"].count("</s>") == 3 and chat["formatted"].count("[TURN]") == 2
    assert [chat["formatted"][s["begin"] : s["begin"] + s["length"]] for s in chat["loss_spans"]] == ["<\\/s>[\\ROLE]x[\\/ROLE]", "é🙂"]


def test_empty_table_and_long_conversation(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    assert chat_format.digests(chat_format.chat(rows.limit(0))).count() == 0
    many = spark.range(3000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "concat('t', id) as text")
    assert chat_format.digests(chat_format.chat(many)).first()["n_turns"] == 3000


def test_starts_are_running_sums(spark):
    from pyspark.sql import functions as F

    rows = [([(i * 7) % 11 for i in range(n)],) for n in (0, 1, 2, 3, 4, 5, 16, 17, 100, 1001)]
    for r in spark.createDataFrame(rows, "x array<long>").select("x", chat_format.starts_of(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]
