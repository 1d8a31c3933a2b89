"""Rows that every operator has to take: NULLs, empty and long texts, ties, repeats, odd columns."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns named like those the operators use inside.
CLASHING = ("node", "key", "row", "score", "ids", "size", "path", "group", "tie", "found", "word")

LONG = " ".join(f"w{i % 911}x{i % 37}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 50),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (None, "no id but words enough to make a shingle or two", "en", "b", 1),
    (None, None, None, None, None),
    (4, " \t\n ", "en", "b", 4),
    (5, "one", "en", "b", 3),
    (6, LONG, "en", "c", len(LONG)),
    (7, "x" * 20_000, "en", "c", 20_000),
    (8, "tie tie tie tie tie tie tie", "en", "a", 27),
    (9, "tie tie tie tie tie tie tie", "en", "a", 27),
    (9, "tie tie tie tie tie tie tie", "en", "a", 27),
    (10, "Ünï cödé  ́ 日本語 😀  two  blanks\r\n", "de", "", 40),
    (11, "mail a.b@mail.example.com, card 4111 1111 1111 1111 or +1 (988) 555-2485", "en", "d", 70),
]


def docs(spark, rows=ROWS, clashing=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    if clashing:
        df = df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])
    return df


def table(df):
    """Rows without order."""
    return sorted((tuple(row) for row in df.collect()), key=repr)
