"""Exact duplicates by content-defined chunk recipes, in DataFrame functions alone.

A normalised text (A-Z in lower case) is cut where its content says so: behind a word whose hash has
``log2(every)`` zero bits, so equal passages of different documents give equal chunks wherever they
stand. A run of ``most`` words without such a word is cut from its start on in steps of ``most``.

    recipes   one row per document: its number, id, SHA-256 and chunks (fingerprint, body); written
    names     fingerprints that stand for two or more bodies, each body with an ordinal; written
    groups    one row per distinct recipe: the row that stays and the number of rows

Chunk bodies are shuffled once, after equal ones of a task have met. A fingerprint counts as the
identifier of a chunk only if the dictionary knows one body for it. Bodies that share a fingerprint
are told apart by an ordinal, and the documents that hold them carry (place, ordinal) beside their
fingerprints. So two documents have equal lists of identifiers if and only if their texts are equal,
whatever the fingerprint function; nothing rests on its odds. What meets other documents is lists of
identifiers, about a hundredth of the text. Groups are counted before their rows are met again, and
rows of large groups are spread by salt.

Defined results: NULL text counts as empty, and an empty text has no chunks. Of equal rows with the
same largest id exactly one stays; a NULL id is smaller than every other. Repeated rows are rows of
their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calibrant.llm.tables import written
from calibrant.operators.joins import salted_join
from calibrant.operators.staging import computed_once

#: Words with the blanks behind them; a longer word is cut into such pieces. Covers every text.
PIECES = r"\S{1,64}\s{0,64}|\s{1,64}"
FIXES = "array<struct<place:int,ordinal:int>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Fingerprint = Callable[[Column], Column]


def _lowered(piece: Column) -> Column:
    """A-Z in lower case. ``lower`` does that fast, but to other letters too, so it gets ASCII only."""
    ascii_only = F.octet_length(piece) == F.char_length(piece)
    return F.when(ascii_only, F.lower(piece)).otherwise(F.translate(piece, _UPPER, _LOWER))


def cut(docs: DataFrame, text: str = "text", every: int = 128, most: int = 1024) -> DataFrame:
    """Adds ``body`` (the normalised text) and ``chunks``, an array of strings that make up the body."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECES), F.lit(0))
    pieces = computed_once(docs, _pieces=F.transform(found, _lowered))
    last = F.size("_pieces")
    ends = F.array_compact(F.transform("_pieces", lambda piece, i: F.when(
        (F.pmod(F.xxhash64(piece), F.lit(every)) == 0) | (i + 1 == last), i + 1)))
    marked = computed_once(pieces, _ends=ends)
    runs = F.transform("_ends", lambda end, i: F.struct(
        F.when(i == 0, 0).otherwise(F.get("_ends", i - 1)).alias("begin"), end.alias("end")))
    spans = F.flatten(F.transform(runs, lambda run: F.transform(
        F.sequence(run["begin"], run["end"] - 1, F.lit(most)),
        lambda begin: F.struct(
            begin.alias("begin"), F.least(begin + most, run["end"]).alias("end")))))
    spans = F.transform(spans, lambda span: F.array_join(
        F.slice("_pieces", span["begin"] + 1, span["end"] - span["begin"]), ""))
    return marked.select(
        "*", F.array_join("_pieces", "").alias("body"), spans.alias("chunks")
    ).drop("_pieces", "_ends")


def write_recipes(docs: DataFrame, fingerprint: Fingerprint = F.xxhash64, **options) -> DataFrame:
    """One row per document: ``row``, ``doc_id``, ``text_sha256``, ``chunks`` (name, body).

    Numbers of rows are fixed by writing them.
    """
    parts = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), **options)
    return written(parts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"),
        F.transform("chunks", lambda chunk: F.struct(
            fingerprint(chunk).alias("name"), chunk.alias("body"))).alias("chunks"),
    ), "recipes")


def chunk_store(recipes: DataFrame) -> DataFrame:
    """Every distinct chunk once: ``name``, ``body``."""
    return recipes.select(F.inline("chunks")).distinct()


def ordinals(recipes: DataFrame) -> DataFrame:
    """``name``, ``body`` and ``ordinal`` of the chunks whose fingerprint has several bodies; written."""
    shared = written(
        chunk_store(recipes).groupBy("name").agg(F.count(F.lit(1)).alias("bodies"))
        .where("bodies > 1").select("name"), "shared-names")
    several = recipes.select(F.inline("chunks")).join(shared, "name", "left_semi").distinct()
    order = Window.partitionBy("name").orderBy("body")
    return written(
        several.withColumn("ordinal", F.row_number().over(order)).where("ordinal > 1"), "names")


def identified(recipes: DataFrame) -> DataFrame:
    """``row``, ``doc_id``, ``text_sha256`` and the verified list: ``names`` and ``fixes``.

    ``fixes`` holds (place, ordinal) of the chunks that are not the first body of their fingerprint.
    """
    fixes = (
        recipes.select("row", F.posexplode("chunks").alias("place", "chunk"))
        .select("row", "place", "chunk.name", "chunk.body")
        .join(ordinals(recipes), ["name", "body"])
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "ordinal"))).alias("fixes")))
    return recipes.select(
        "row", "doc_id", "text_sha256", F.col("chunks.name").alias("names")
    ).join(fixes, "row", "left").withColumn("fixes", F.coalesce("fixes", F.array().cast(FIXES)))


def group_rows(lists: DataFrame) -> DataFrame:
    """Adds ``keep_id``, ``group_size`` and ``kept`` to rows with identifier lists."""
    smallest = F.lit(-(1 << 63))
    groups = lists.groupBy("names", "fixes").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"),
        F.max_by("row", F.coalesce("doc_id", smallest)).alias("stays"),
    ).where("group_size > 1")
    met = salted_join(lists, groups, ["names", "fixes"], "left", "row")
    single = F.col("stays").isNull()
    return met.select(
        "row", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("stays") == F.col("row"))).alias("kept"), "text_sha256")


def duplicate_table(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256; one row per row of ``docs``."""
    return group_rows(identified(write_recipes(docs, **options))).drop("row")
