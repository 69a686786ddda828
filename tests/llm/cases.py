"""Rows that every operator must survive: nulls, empty, long, tied, repeated, and columns with clashing names."""

import random

LONG = " ".join(f"word{i % 97} thing{i % 13}" for i in range(30_000))


def documents(spark, n=60, seed=7):
    """A small table of documents with awkward rows and columns named like the operators' own."""
    rng = random.Random(seed)
    common = "the of and to in clean plain water river stone".split()
    rows = []
    for i in range(n):
        words = [rng.choice(common) + rng.choice(["", "", "s", "ing", ","]) for _ in range(rng.randint(0, 80))]
        text = "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text), i, "x", 1.5))
    twice = "one two three four five six seven eight nine ten eleven twelve"
    rows += [
        (100, None, None, None, None, 1, None, None),
        (101, "", "", "", 0, 1, "", 0.0),
        (102, " \t\n\x0b\x0c\r ", "en", "src0", 7, 1, "x", 0.0),
        (103, LONG, "en", "src0", len(LONG), 1, "x", 0.0),
        (104, twice + "\n" + twice + "\n" + twice, "en", "src1", 1, 1, "x", 0.0),
        (105, "naïve café — ñandú 東京 🙂  x y # * $ %&|<>", "fr", "Src2", 1, 1, "x", 0.0),
        (106, "a" * 5000 + "  <|endoftext|> \r\n\r\n   end", "en", "srcZ", 1, 1, "x", 0.0),
        (107, "tie words here\ntie words here\n\n \ntie words here", "de", "src3", 1, 1, "x", 0.0),
        (107, "tie words here\ntie words here\n\n \ntie words here", "de", "src3", 1, 1, "x", 0.0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words long, row string, size double")
