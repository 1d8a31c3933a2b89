"""Figures per training step, drained from a stream of scored answers.

Every batch drains what has come since the last one: the state of a step takes it in and the figures
of the step so far go out. State is a few sums per step, and one sum per calibration bin, whatever
the number of answers. A timer closes a step when the watermark is ``patience`` past its last answer;
its last figures go out once more, marked ``closed``, and its state is dropped. Later answers of the
step are beyond the watermark.

Calibration error needs ``min_valid`` answers with a probability. Answers without one count in the
format rate and in the length. NULL steps are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from calibrant.functions.scoring import calibration_bin
from calibrant.operators.cleaning import demanded
from calibrant.streaming.table import BATCH, BatchTable

FIGURES = ["format_success_rate", "mean_completion_chars", "mean_brier_reward", "mean_reward",
           "mean_predicted_prob", "mean_confidence", "pred_prob_std", "batch_ece"]
OUTPUT = ("step bigint, answers bigint, " + ", ".join(f"{name} double" for name in FIGURES) + ", closed boolean")
#: Answers, those with a probability, then sums; the spread by its mean and squared deviations.
_SUMS = ["chars", "brier", "reward", "p", "confidence", "mean", "m2"]
_STATE = ("answers bigint, valid bigint, last bigint, " + ", ".join(f"{name} double" for name in _SUMS)
          + ", gaps array<double>")
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Step(StatefulProcessor):
    def __init__(self, min_valid: int, n_bins: int, patience_ms: int):
        self._min_valid, self._n_bins, self._patience = min_valid, n_bins, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("sums", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self._state.exists():
            answers, valid, last, *sums, gaps = self._state.get()
            gaps = np.array(gaps, dtype=float)
        else:
            answers, valid, last, sums, gaps = 0, 0, 0, [0.0] * len(_SUMS), np.zeros(self._n_bins)
        sums = dict(zip(_SUMS, sums))
        for batch in rows:
            good = batch[batch["prob"].notna()]
            answers += len(batch)
            last = max(last, int(batch["at"].max()))
            sums["chars"] += float(batch["chars"].sum())
            if len(good):
                p, n = good["prob"].to_numpy(float), len(good)
                sums["brier"] += float(good["brier_reward"].sum())
                sums["reward"] += float(good["reward"].sum())
                sums["p"] += float(p.sum())
                sums["confidence"] += float(np.abs(p - 0.5).sum())
                apart = p.mean() - sums["mean"]
                sums["m2"] += float(((p - p.mean()) ** 2).sum()) + apart * apart * valid * n / (valid + n)
                sums["mean"] += float(apart * n / (valid + n))
                valid += n
                np.add.at(gaps, good["bin"].to_numpy(int), p - good["outcome"].to_numpy(float))
        self._state.update((answers, valid, last, *[sums[name] for name in _SUMS], gaps.tolist()))
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        self._handle.registerTimer(last + self._patience)
        yield self._figures(key[0], answers, valid, sums, gaps, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        answers, valid, _, *sums, gaps = self._state.get()
        self._state.clear()
        yield self._figures(key[0], answers, valid, dict(zip(_SUMS, sums)), np.array(gaps, dtype=float), True)

    def _figures(self, step, answers, valid, sums, gaps, closed) -> pd.DataFrame:
        def mean(name: str, n: int) -> float | None:
            return sums[name] / n if n else None

        return pd.DataFrame({
            "step": [step], "answers": [answers], "format_success_rate": [valid / answers],
            "mean_completion_chars": [mean("chars", answers)], "mean_brier_reward": [mean("brier", valid)],
            "mean_reward": [mean("reward", valid)], "mean_predicted_prob": [mean("p", valid)],
            "mean_confidence": [mean("confidence", valid)],
            "pred_prob_std": [math.sqrt(sums["m2"] / valid) if valid else None],
            "batch_ece": [float(np.abs(gaps).sum()) / valid if valid >= self._min_valid else None],
            "closed": [closed]}).astype({name: "float64" for name in FIGURES})

    def close(self) -> None:
        pass


def drained_telemetry(
    stream: DataFrame, ts: str = "ts", step: str = "step", lateness: str = "1 hour",
    patience_seconds: float = 3600, min_valid: int = 20, n_bins: int = 10,
) -> DataFrame:
    """Figures of every step that had answers in a batch, and of those that closed.

    ``stream`` has a time, a step, ``reward`` structs, ``outcome`` and ``chars``.
    """
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    p = F.when(F.col("reward.format_ok"), F.col("reward.prob"))
    rows = demanded(stream, F.col(step).isNotNull(), f"{step} is NULL").withWatermark(ts, lateness).select(
        F.col(step).cast("bigint").alias("step"), F.col(ts).alias("_ts"),
        F.unix_millis(F.col(ts).cast("timestamp")).alias("at"),
        F.coalesce(F.col("chars").cast("double"), F.lit(0.0)).alias("chars"), p.alias("prob"),
        F.col("reward.brier_reward").alias("brier_reward"), F.col("reward.reward").alias("reward"),
        F.col("outcome").cast("double").alias("outcome"), calibration_bin(p, n_bins).alias("bin"))
    return rows.groupBy("step").transformWithStateInPandas(
        statefulProcessor=_Step(min_valid, n_bins, int(1000 * patience_seconds)),
        outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")


def start_drain(
    figures: DataFrame, path: str, checkpoint: str, available_now: bool = True, merge_every: int = 16,
) -> StreamingQuery:
    """Write the figures of every step that changed; one writer at a time."""
    table = BatchTable(figures.sparkSession, path, ["step"], merge_every)

    def commit(batch: DataFrame, number: int) -> None:
        # A step that closes in the batch in which it also had answers comes twice: the closing one counts.
        rest = [c for c in batch.columns if c != "step"]
        last = batch.groupBy("step").agg(F.max_by(F.struct(*rest), F.struct("answers", "closed")).alias("_last"))
        table.commit(last.select("step", "_last.*"), number)

    writer = figures.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_figures(spark, path: str) -> DataFrame:
    """The newest figures of every step."""
    table = BatchTable(spark, path, ["step"]).read()
    if table is None:
        raise ValueError(f"no batch has been written to {path}")
    return table.drop(BATCH)
