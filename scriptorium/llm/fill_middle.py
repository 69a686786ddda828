"""Fill-in-middle transformation: a text cut at two token starts and written as prefix, suffix, middle.

A text is one large integer with a bit for each code point. `bytes.translate` makes it of the letters; and with itself
shifted by one place, it marks each letter after a letter, so the rest are the places where tokens start. `bit_count`
gives their number, and halving the integer again and again finds the start of any rank, in time that is linear in the
text. What is cut where depends on the document's id alone, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import bounded_batches, q, unpacked

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, those that are transformed at all, and of these those that have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: "1" for an ASCII letter, "0" for any other byte.
_CLASS = bytes(b"01"[chr(b).isalpha() and b < 128] for b in range(256))


def token_starts(text: str) -> int:
    """Bit i is set where a token starts at code point i: a run of ASCII letters, or any one other code point."""
    letters = int(text.encode("ascii", "replace").translate(_CLASS)[::-1] or b"0", 2)
    return ((1 << len(text)) - 1) ^ (letters & (letters << 1))


def nth_bit(bits: int, size: int, rank: int) -> int:
    """The place of the set bit with `rank` set bits below it, among the lowest `size` places."""
    at = 0
    while size > 1:
        half = size // 2
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if rank < below:
            bits, size = low, half
        else:
            bits, size, rank, at = bits >> half, size - half, rank - below, at + half
    return at


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(tokens, end of the prefix, end of the middle) in code points, for two numbers drawn at random."""
    starts = token_starts(text)
    n = starts.bit_count()
    low, high = sorted((first % (n + 1), second % (n + 1)))
    return n, *(len(text) if k == n else nth_bit(starts, len(text), k) for k in (low, high))


def transformed(text: str, doc_id: str) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, code points of the prefix, of the middle, output)."""
    digest = sha256(f"1:{doc_id}".encode()).hexdigest()
    first, second, third, fourth = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, low, high = cuts(text, first, second)
    if not text or third % 100 >= CHANGED or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if fourth % 100 < SUFFIX_FIRST:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


_MADE = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType()))])


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of `docs` with n (tokens of its whole text), form (plain, psm or spm), prefix_chars, middle_chars, output.

    A null text is an empty one; empty texts and those that hold a mark stay plain, with null lengths. A null id is the
    empty string, rows of one id are cut by the same numbers, repeated rows stay repeated. Columns of `docs` with one of
    the five names are replaced, all others kept; an empty table gives an empty table. Nothing is shuffled.
    """
    names, made = [c for c in docs.columns if c not in _MADE.names], _MADE.names
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows = docs.select(F.struct(F.lit(0), *[q(c) for c in names]).alias("_row"), q(text).cast("string").alias("_text"), q(doc_id).cast("string").alias("_id"))
    schema = T.StructType([rows.schema["_row"], *_MADE.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [transformed(x or "", i or "") for x, i in zip(part.column("_text").to_pylist(), part.column("_id").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("_row"), *[pa.array(x, t) for x, t in zip(zip(*found), types)]], names=["_row", *made])

    return bounded_batches(rows).mapInArrow(run, schema).select(*unpacked(docs, names, "_row"), *made)


def restored(output: Column, form: Column) -> Column:
    """The text that transform() had, from its output and form; built-in functions only.

    A text that holds a mark is plain, and no mark can arise across the ends of its parts, as each starts with its only
    `<` and ends with its only `>`."""

    def parts(first: str, second: str) -> Column:
        return F.split(F.substr(output, F.lit(len(first) + 1)), f"{second}|{MIDDLE}", -1)

    psm, spm = parts(PREFIX, SUFFIX), parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and digests of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
