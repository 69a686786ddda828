"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

All figures of a text come out of one pass of built-in array functions. `F.inline` over a one-element array binds the
word array once; the optimiser neither repeats it for each figure nor pulls a filter in front of it.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import BLANK, BLANKS, packed, unpacked, word_array

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Frequent function words of English, French, German and Spanish, lower case and capitalised.
_STOP = "the of and to in is that for it as was with be by on not he this are or his from at which a an de la le et les des en un une du que qui dans est pour au il par sur der die und das von den zu mit sich des auf für ist im dem nicht ein eine als auch el los las y del se por con para una su lo no al".split()
STOP_WORDS = sorted({*_STOP, *(w.capitalize() for w in _STOP)})

#: (figure, least, most); None: no bound. A text is kept if it keeps all of them and isn't base_failed.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("n_words", 10, 1_000_000),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.2),
    ("mark_ratio", None, 0.5),
    ("stop_ratio", 0.04, None),
    ("dup_line_ratio", None, 0.3),
]


def _figures(text: Column) -> Column:
    """One struct of counts, from the text and its words."""
    some = F.lit(WINDOW)

    def repeats(grams: Column) -> Column:
        """Words covered by windows that occur twice or more: sort (hash, place), keep equal neighbours, join their spans."""
        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
        places = F.transform(F.array(pairs), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))[0]
        spans = F.transform(F.array(places), lambda p: F.transform(p, lambda at, k: F.least(some, F.coalesce(F.get(p, k + 1) - at, some))))[0]
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    def of(words: Column) -> Column:
        count = F.size(words)
        grams = F.when(count >= WINDOW, F.transform(F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
        repeated = F.transform(F.array(grams), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), repeats(g)).otherwise(0))[0]
        lines = F.transform(
            F.array(F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK[1:]}"))),
            lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
        )[0]
        return F.struct(
            count.cast("long").alias("n_words"),
            F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            lines.alias("lines"),
            repeated.cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            (F.length(text) - F.length(F.translate(text, "!|", ""))).cast("long").alias("n_marks"),
        )

    return F.inline(F.transform(F.array(word_array(text)), of))


def _verdict(thresholds: list[tuple[str, float | None, float | None]]) -> Column:
    kept = [F.col(name) >= least for name, least, _ in thresholds if least is not None] + [F.col(name) <= most for name, _, most in thresholds if most is not None]
    return reduce(and_, kept, F.lit(True))


def measure(docs: DataFrame, text: str = "text", thresholds=None) -> DataFrame:
    """`row` (the whole input row as a struct) and its figures, base_failed and kept.

    Null texts count as empty: no words, base_failed, not kept. Very long texts are measured whole, with memory in
    proportion to the text. Windows are compared by 64-bit hashes of their five words. Repeated rows get equal figures;
    an empty table gives an empty table.
    """
    thresholds = THRESHOLDS if thresholds is None else thresholds
    rows = packed(docs).withColumn("_text", F.coalesce(F.col("row").getField(text).cast("string"), F.lit("")))
    found = rows.select("row", _figures(F.col("_text")))
    words = F.greatest(F.col("n_words"), F.lit(1))
    ratios = found.select(
        "row", "n_words", "word_chars", "n_symbols", F.col("lines.dup").cast("long").alias("n_dup_lines"), "n_repeat_words", "n_stop_words",
        (F.col("word_chars") / words).alias("mean_word_chars"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_marks") / words).alias("mark_ratio"),
        (F.col("n_stop_words") / words).alias("stop_ratio"),
        (F.col("lines.dup") / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_ratio"),
    )
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return ratios.select("*", base.alias("base_failed"), (~base & _verdict(thresholds)).alias("kept"))


def keep(docs: DataFrame, text: str = "text", thresholds=None) -> DataFrame:
    """The rows of `docs`, in their own columns, that keep all rules.

    Null, empty and blank texts have no words and so never keep them, repeated rows stay repeated, an empty table gives an
    empty table, and columns of any name stay the caller's."""
    return measure(docs, text, thresholds).where("kept").select(*unpacked(docs, docs.columns))
