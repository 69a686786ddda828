"""Chat formatting with Spark expressions only: sort turns, merge neighbours of one role, concatenate, and read back.

A formatted conversation is a row of blocks, one for each run of turns of the same role:

    <s>[ROLE]role[/ROLE][INST]text[TURN]text[/INST]</s>      read, not learnt
    <s>[ROLE]assistant[/ROLE]text[TURN]text</s>              its texts are under the loss mask

Control strings inside texts and roles get one more backslash behind their first character (`<s>` becomes `<\\s>`, and
`<\\s>` becomes `<\\\\s>`), which reading back removes; nothing else in a text changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import q

LEARNT = "assistant"
#: A binary value has fewer than 2^31 bytes: texts of more code points, and malformed ones, are cut by counting.
MOST_WIDE = 500_000_000
_NAMES = r"/?(?:s>|INST\]|ROLE\]|TURN\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{_NAMES})", r"$1\\$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{_NAMES})", r"$1$2")


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id and its sorted turns.

    Turns are ordered by turn, then role, then text; null turns come first, null roles and texts are empty. A
    conversation is one output row, so its turns meet in one task; they are first gathered in up to 64 parts by turn,
    and what remains there for a conversation of any length is one row for each part.
    """
    parts = (
        rows.select(
            q(conv_id).alias("conv_id"),
            (F.coalesce(q(turn).cast("long"), F.lit(0)) % 64).alias("part"),
            F.struct(q(turn).cast("long").alias("turn"), F.coalesce(q(role).cast("string"), F.lit("")).alias("role"), F.coalesce(q(text).cast("string"), F.lit("")).alias("text")).alias("t"),
        )
        .groupBy("conv_id", "part")
        .agg(F.collect_list("t").alias("some"))
    )
    return parts.groupBy("conv_id").agg(F.sort_array(F.flatten(F.collect_list("some"))).alias("turns"))


def chat(rows: DataFrame, learnt: str = LEARNT, **names: str) -> DataFrame:
    """conv_id, formatted text, and loss_spans: begin and length, in code points, of each text under the loss mask.

    Every row of the input is one turn, repeated rows too; rows with a null conv_id form one conversation; an empty
    table gives an empty table; columns beside the four named ones are not looked at.
    """
    return formatted(turns(rows, **names), learnt)


def _bound(value: Column, work: Callable[[Column], Column]) -> Column:
    """work(value), with the value computed once."""
    return F.transform(F.array(value), work)[0]


def starts_of(lengths: Column) -> Column:
    """What comes before each place of an array of lengths, in all.

    Sums run over stretches of some square root of the size, then over the stretches: an array that grows at its end is
    copied at each step, so one run over n lengths would take n * n.
    """
    empty = F.array().cast("array<bigint>")

    def run(x: Column) -> Column:
        step = lambda a, n: F.struct((a["all"] + n).alias("all"), F.concat(a["starts"], F.array(a["all"])).alias("starts"))
        return F.aggregate(x, F.struct(F.lit(0).cast("bigint").alias("all"), empty.alias("starts")), step)

    def of(all_lengths: Column) -> Column:
        wide = F.ceil(F.sqrt(F.size(all_lengths))).cast("int")
        stretches = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_lengths) - 1) / w).cast("int")), lambda i: run(F.slice(all_lengths, i * w + 1, w)))
        joined = lambda parts: F.flatten(F.zip_with(parts, run(F.transform(parts, lambda x: x["all"]))["starts"], lambda x, at: F.transform(x["starts"], lambda s: s + at)))
        return F.when(F.size(all_lengths) > 0, _bound(wide, lambda w: _bound(stretches(w), joined))).otherwise(empty)

    return _bound(lengths, of)


def formatted(rows: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """conv_id, formatted and loss_spans from conv_id and sorted turns."""

    def blocks(all_turns: Column) -> Column:
        """Runs of one role: their first places, then a slice from each to the next."""
        first = F.filter(F.transform(all_turns, lambda t, k: F.when(F.coalesce(F.get(all_turns, k - 1)["role"] == t["role"], F.lit(False)), F.lit(-1)).otherwise(k)), lambda k: k >= 0)
        run = lambda starts: F.transform(
            starts,
            lambda at, j: F.struct(
                F.get(all_turns, at)["role"].alias("role"),
                F.transform(F.slice(all_turns, at + 1, F.coalesce(F.get(starts, j + 1), F.size(all_turns)) - at), lambda t: escaped(t["text"])).alias("texts"),
            ),
        )
        return F.transform(F.array(first), run)[0]

    def pieces(b: Column) -> Column:
        """The strings of a block in order, and which of them are under the loss mask."""
        own = b["role"] == F.lit(learnt)
        head = F.concat(F.lit("<s>[ROLE]"), escaped(b["role"]), F.lit("[/ROLE]"), F.when(own, "").otherwise("[INST]"))
        bodies = F.flatten(F.transform(b["texts"], lambda x, k: F.array(F.struct(F.when(k == 0, "").otherwise("[TURN]").alias("s"), F.lit(False).alias("on")), F.struct(x.alias("s"), own.alias("on")))))
        tail = F.when(own, "</s>").otherwise("[/INST]</s>")
        return F.concat(F.array(F.struct(head.alias("s"), F.lit(False).alias("on"))), bodies, F.array(F.struct(tail.alias("s"), F.lit(False).alias("on"))))

    def spans(all_pieces: Column) -> Column:
        lengths = F.transform(all_pieces, lambda x: F.length(x["s"]).cast("long"))
        each = F.zip_with(F.zip_with(all_pieces, lengths, lambda x, n: F.struct(x["on"].alias("on"), n.alias("length"))), starts_of(lengths), lambda x, at: F.struct(x["on"].alias("on"), F.struct(at.alias("begin"), x["length"].alias("length")).alias("span")))
        return F.transform(F.filter(each, lambda x: x["on"]), lambda x: x["span"])

    made = F.transform(F.transform(F.array(F.col("turns")), lambda t: F.flatten(F.transform(blocks(t), pieces))), lambda p: F.struct(F.array_join(F.transform(p, lambda x: x["s"]), "").alias("formatted"), spans(p).alias("loss_spans")))
    return rows.select("conv_id", F.inline(made))


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id and the turns (role, text) in order, and the text under the loss mask, all from the formatted text alone.

    Spans are cut out of the text in an encoding of four bytes for each code point, where each is found at once.
    """
    head = r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\](?:\[INST\])?"
    body = lambda b: F.regexp_replace(F.regexp_replace(b, head, ""), r"\[/INST\]$", "")
    texts = lambda b, role: F.transform(F.split(body(b), r"\[TURN\]"), lambda x: F.struct(role.alias("role"), unescaped(x).alias("text")))
    turns_of = lambda b: _bound(unescaped(F.regexp_extract(b, head, 1)), lambda role: texts(b, role))
    blocks = lambda f: F.filter(F.split(f, "</s>"), lambda b: b != "")
    wide = lambda f: F.transform(F.col("loss_spans"), lambda s: F.decode(F.substring(f, (4 * s["begin"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))
    plain = lambda f: F.transform(F.col("loss_spans"), lambda s: F.substring(f, (s["begin"] + 1).cast("int"), s["length"].cast("int")))
    short = F.is_valid_utf8(F.col("formatted")) & (F.length("formatted") < MOST_WIDE)
    cut_out = F.when(short, _bound(F.encode(F.col("formatted"), "UTF-32"), wide)).otherwise(plain(F.col("formatted")))
    return chats.select("conv_id", "formatted", F.flatten(F.transform(blocks(F.col("formatted")), turns_of)).alias("turns"), F.array_join(F.transform(cut_out, unescaped), "").alias("loss_text"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what read_back() finds."""
    back = read_back(chats)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
