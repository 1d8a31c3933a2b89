"""One large prediction file, pretty-printed or not, read by many tasks.

The text source is asked for lines that end at ``}``, so it splits a file of one object into byte
ranges like any other, and what comes are segments of the object in their order. Whether a segment's
brace is one of the object's or stands inside a text depends on all quotes before it. That is a running
parity, and the depth after it a running sum: every range adds up its own segments, the ranges of a
file (one row each) are added up in order, and a segment's state is its range's start plus what is
before it in the range. Numbers of records and the variant they belong to run along in the same way.

A record that lies in one segment, as records without ``}`` in their texts do, is parsed where it is
read; the segments of the others are brought together by record. A file that ends inside its object is
an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from calibrant.operators.cleaning import nan_as_null
from calibrant.schemas import PREDICTION
from calibrant.session import stored

SINGLE_VARIANT = "_"
_FILE, _AT = ["_file"], ["_file", "_block"]
#: Text up to the first brace outside of strings, and names in front of a colon.
_FRONT = r'(?s)^((?:[^"{]|"(?:[^"\\]|\\.)*+")*+)\{'
_NAME = r'(?s)("(?:[^"\\]|\\.)*+")\s*:'


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their file, the start of their byte range, and their order inside it."""
    return spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"), F.monotonically_increasing_id().alias("_i"),
        F.col("value"), (F.octet_length("value") + 1).alias("_bytes"),
        F.regexp_replace("value", r"(?s)\\.", "").alias("_bare")
    ).withColumn("_quotes", F.length("_bare") - F.length(F.replace("_bare", F.lit('"'), F.lit(""))))


def _inside():
    return Window.partitionBy(*_AT).orderBy("_i")


def _before(name: str) -> Column:
    """The sum over earlier segments of the range."""
    return F.sum(name).over(_inside()) - F.col(name)


def _starts(blocks: DataFrame, names: list[str], label: str) -> DataFrame:
    """Per range the sums over all earlier ranges of its file; a row per range."""
    order = Window.partitionBy(*_FILE).orderBy("_block")
    return stored(blocks.select(
        *_AT, *[(F.sum(n).over(order) - F.col(n)).alias(f"{n}_start") for n in names],
        *[F.sum(n).over(Window.partitionBy(*_FILE)).alias(f"{n}_all") for n in names]), label)


def _with_depth(spark: SparkSession, path: str) -> DataFrame:
    """Segments with the depth before and after them and whether their brace closes anything."""
    segments = _segments(spark, path)
    quotes = _starts(segments.groupBy(*_AT).agg(
        F.sum("_quotes").alias("_quotes"), F.sum("_bytes").alias("_bytes")), ["_quotes", "_bytes"], "map-quotes")
    odd = (F.col("_quotes_start") + _before("_quotes")) % 2 == 1
    known = segments.join(F.broadcast(quotes), _AT).withColumn("_odd", odd)
    # What is outside of strings; a string that is open at the end is cut off with the segment.
    outside = F.regexp_replace(F.when(F.col("_odd"), F.concat(F.lit('"'), "_bare")).otherwise(F.col("_bare")),
                               r'(?s)"[^"]*+(?:"|$)', "")
    known = known.withColumn("_outside", outside).withColumns({
        "_opens": F.length("_outside") - F.length(F.replace("_outside", F.lit("{"), F.lit(""))),
        "_ends_in_text": (F.col("_odd").cast("int") + F.col("_quotes")) % 2 == 1})
    # With a brace behind every segment the file would be longer than it is if something follows its
    # last brace; that rest closes nothing.
    upto = F.col("_bytes_start") + F.sum("_bytes").over(_inside())
    rest = upto > F.col("_size")
    return known.withColumn("_rest", rest).withColumn(
        "_closes", (~F.col("_ends_in_text") & ~F.col("_rest")).cast("int")).withColumn(
        "_turn", F.col("_opens") - F.col("_closes"))


def read_large_maps(spark: SparkSession, path: str) -> DataFrame:
    """Long predictions of files that each hold one object ``{variant: [...]}`` or one bare array."""
    segments = _with_depth(spark, path)
    first = Window.partitionBy(*_FILE)
    shape = segments.groupBy(*_AT).agg(
        F.sum("_turn").alias("_turn"),
        F.min_by(F.substring(F.trim(F.regexp_replace("_outside", r"^\s+", "")), 1, 1), "_i").alias("_head"))
    blocks = shape.withColumn("_head", F.first("_head").over(first.orderBy("_block")))
    order = Window.partitionBy(*_FILE).orderBy("_block")
    depths = stored(blocks.select(
        *_AT, (F.col("_head") == "{").cast("int").alias("_base"),
        (F.sum("_turn").over(order) - F.col("_turn")).alias("_turn_start"),
        F.sum("_turn").over(first).alias("_turn_all")), "map-depths")
    broken = [row["_file"] for row in depths.where("_turn_all != 0").select("_file").distinct().limit(3).collect()]
    if broken:
        raise ValueError(f"not one whole object: {', '.join(broken)}")
    segments = segments.join(F.broadcast(depths), _AT).withColumn(
        "_deep", F.col("_turn_start") + _before("_turn")).withColumn(
        "_end", ((F.col("_closes") == 1) & (F.col("_deep") + F.col("_turn") == F.col("_base"))
                 & (F.col("_deep") + F.col("_opens") > F.col("_base"))).cast("int"))
    counts = _starts(segments.groupBy(*_AT).agg(F.sum("_end").alias("_end")), ["_end"], "map-counts")
    segments = segments.join(F.broadcast(counts.drop("_end_all")), _AT).withColumn(
        "_record", F.col("_end_start") + _before("_end")).withColumn(
        "value", F.when(F.col("_rest"), F.col("value")).otherwise(F.concat("value", F.lit("}"))))
    # A segment is a record by itself if the one before it ended a record.
    segments = segments.withColumn("_fresh", F.lag("_end").over(_inside()) == 1)
    alone = F.coalesce((F.col("_end") == 1) & F.col("_fresh"), F.lit(False))
    keep = [*_FILE, "_base", "_record"]
    single = segments.where(alone).select(*keep, "value")
    several = segments.where(~alone & ~F.col("_rest")).groupBy(*keep).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", "_i", "value"))),
                                 lambda part: part["value"]), "").alias("value"),
        F.max("_end").alias("_whole")).where("_whole = 1").drop("_whole")
    texts = single.unionByName(several)
    # The object's own brace is not the first record's.
    texts = texts.withColumn("value", F.when(
        (F.col("_base") == 1) & (F.col("_record") == 0), F.regexp_replace("value", r"^[^{]*\{", "")
    ).otherwise(F.col("value"))).withColumn("_front", F.regexp_extract("value", _FRONT, 1))
    names = F.regexp_extract_all("_front", F.lit(_NAME), F.lit(1))
    texts = texts.withColumn("_name", F.get(names, F.size(names) - 1))
    variants = stored(texts.where("_name is not null").select(
        *_FILE, F.col("_record").alias("_begin"),
        F.from_json(F.concat(F.lit("["), "_name", F.lit("]")), "array<string>")[0].alias("variant")), "map-variants")
    # A row per variant and file.
    following = Window.partitionBy(*_FILE).orderBy("_begin")
    variants = variants.withColumn("_next", F.coalesce(F.lead("_begin").over(following), F.lit(1 << 62)))
    parsed = texts.join(F.broadcast(variants.withColumnRenamed("_file", "_of")), (
        F.col("_file") == F.col("_of")) & (F.col("_record") >= F.col("_begin")) & (
        F.col("_record") < F.col("_next")), "left").select(
        "_file", F.coalesce("variant", F.lit(SINGLE_VARIANT)).alias("variant"),
        (F.col("_record") - F.coalesce("_begin", F.lit(0))).cast("bigint").alias("_pos"),
        F.from_json(F.substr("value", F.length("_front") + 1), PREDICTION, {"mode": "FAILFAST"}).alias("r"))
    shared = [row["variant"] for row in variants.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n")).where("n > 1").collect()]
    files = counts.select(*_FILE).distinct().count()
    if files > 1:
        shared.append(SINGLE_VARIANT)
    clashing = parsed.where(F.col("variant").isin(shared) & F.col("r.row_id").isNull()) if shared else None
    if clashing is not None and clashing.groupBy("variant").agg(
            F.count_distinct("_file").alias("n")).where("n > 1").count():
        raise ValueError("several objects without row ids hold one variant")
    fields = [F.col(f"r.{name}").alias(name) for name in PREDICTION.fieldNames() if name not in ("row_id", "vegas")]
    return nan_as_null(parsed.select(
        "variant", F.coalesce("r.row_id", "_pos").alias("row_id"), *fields, F.col("r.vegas").alias("market")))
