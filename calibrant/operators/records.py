"""From raw plays to question records, training records and trainer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.functions.labels import difficulty, possession_outcome
from calibrant.functions.wording import prompt_mode, render_prompt
from calibrant.operators.staging import computed_once
from calibrant.schemas import FEATURES


def qa_records(plays: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Labelled question records; ties and plays without a market price are dropped.

    ``keep`` names extra columns to carry along, such as a row id.
    """
    labelled = plays.withColumn(
        "actual_outcome",
        possession_outcome(F.col("result"), F.col("posteam"), F.col("home_team")),
    ).where(F.col("actual_outcome").isNotNull() & F.col("vegas_wp").isNotNull())
    features = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURES.fields])
    return computed_once(labelled, question=render_prompt()).select(
        *keep,
        "question",
        F.col("vegas_wp").cast("double").alias("target_prob"),
        "actual_outcome",
        "game_id",
        F.col("season").cast("int").alias("season"),
        F.col("week").cast("int").alias("week"),
        difficulty(F.col("vegas_wp")).alias("difficulty"),
        features.alias("features"),
    )


def training_projection(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Slim records: prompt, outcome, and the market price for evaluation only."""
    meta = F.struct(
        "features.qtr", "features.score_differential", "features.game_seconds_remaining", "week")
    return records.select(
        *keep,
        F.col("question").alias("prompt"),
        "actual_outcome",
        F.col("features.vegas_wp").alias("vegas_wp"),
        "game_id", "season", "difficulty",
        meta.alias("meta"),
    )


def trainer_frame(rows: DataFrame, mode: str = "cot", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chat prompt, outcome and target. Nothing else passes, the market price least of all."""
    message = F.struct(
        F.lit("user").alias("role"), prompt_mode(F.col("prompt"), mode).alias("content"))
    return rows.select(
        *keep,
        F.array(message).alias("prompt"),
        F.col("actual_outcome").cast("int").alias("actual_outcome"),
        F.col("target") if "target" in rows.columns else F.lit(None).cast("double").alias("target"),
    )
