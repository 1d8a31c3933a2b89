import datetime as dt

import pytest
from pyspark.sql import functions as F

from calibrant.operators.calibration import bin_stats, metrics_from_stats
from calibrant.functions.scoring import score_reward_fn
from calibrant.operators.telemetry import reward_telemetry
from calibrant.session import run_folder
from calibrant.streaming import drain, monitor
from calibrant.streaming.table import BatchTable

SCHEMA = "ts timestamp, variant string, prob double, outcome int"
START = dt.datetime(2024, 1, 1)


def write(spark, path, rows):
    spark.createDataFrame(
        [(START + dt.timedelta(minutes=m), v, p, y) for m, v, p, y in rows], SCHEMA
    ).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, folder):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = monitor.start_monitor(
        monitor.stream_stats(stream, "1 hour", "10 minutes"), f"{folder}/table", f"{folder}/state")
    query.awaitTermination()
    return query


def test_stream_equals_batch_on_all_windows(spark):
    """Windows that are still open at the end are reported too, as they stand."""
    source, folder = run_folder(spark, "source"), run_folder(spark, "monitor")
    rows = [(m, "ab"[m % 2], (m * 37 % 101) / 100, m % 3 % 2) for m in range(0, 400, 3)]
    write(spark, source, rows[:80])
    run(spark, source, folder)
    write(spark, source, rows[80:])
    run(spark, source, folder)
    emitted = monitor.monitor_metrics(monitor.latest_stats(spark, f"{folder}/table"))
    batch = spark.read.parquet(source).withColumn("window_start", F.date_trunc("hour", "ts"))
    expected = metrics_from_stats(bin_stats(batch, ["window_start", "variant"]),
                                  ["window_start", "variant"])
    want = {(r["window_start"], r["variant"]): r for r in expected.collect()}
    got = {(r["window_start"], r["variant"]): r for r in emitted.collect()}
    assert got.keys() == want.keys() and len(got) == 14
    for key, row in got.items():
        for name in ("n", "brier", "ece", "mce", "resolution"):
            assert row[name] == pytest.approx(want[key][name], abs=1e-12)


def test_late_rows_are_dropped_and_counted(spark):
    source, folder = run_folder(spark, "source"), run_folder(spark, "monitor")
    write(spark, source, [(5, "a", 0.5, 1), (300, "a", 0.5, 1)])
    run(spark, source, folder)
    write(spark, source, [(6, "a", 0.9, 0), (301, "a", 0.5, 1), (400, "a", 0.5, 1)])
    query = run(spark, source, folder)
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress
                  for op in p["stateOperators"])
    assert dropped == 1
    first = monitor.latest_stats(spark, f"{folder}/table").groupBy("window_start").agg(
        F.sum("n").alias("n")).orderBy("window_start").collect()
    assert [r["n"] for r in first] == [1, 2, 1]


def test_an_illegal_row_is_kept_and_the_stream_goes_on(spark):
    source, folder = run_folder(spark, "source"), run_folder(spark, "monitor")
    write(spark, source, [(1, "a", 0.5, 1), (2, "a", 1.7, 1), (3, "a", 0.25, 7)])
    run(spark, source, folder)
    write(spark, source, [(4, "a", 0.5, 0), (5, "b", float("nan"), 1), (2, "a", 1.7, 1), (9, "b", -0.1, 0)])
    query = run(spark, source, folder)
    assert query.exception() is None
    write(spark, source, [(6, "a", 0.75, 1)])
    run(spark, source, folder)
    stats = monitor.latest_stats(spark, f"{folder}/table")
    assert {r["variant"]: r["n"] for r in stats.groupBy("variant").agg(F.sum("n").alias("n")).collect()} == {"a": 3}
    refused = monitor.refused_rows(spark, f"{folder}/table").select(
        "variant", F.get_json_object("refused", "$.prob").cast("double").alias("p"),
        F.get_json_object("refused", "$.outcome").cast("int").alias("y"), "rows").collect()
    assert sorted(map(tuple, refused)) == [("a", 0.25, 7, 1), ("a", 1.7, 1, 2), ("b", -0.1, 0, 1)]


def folders(table):
    return [*table._names("batch-"), *table._names("merged-")]


def test_many_batches_leave_few_folders(spark):
    """Newest rows count, batches that run again change nothing, and folders are merged."""
    table = BatchTable(spark, run_folder(spark, "merged"), ["k"], merge_every=5)
    assert table.read() is None
    for number in range(23):
        batch = spark.createDataFrame([(number % 3, number), (100 + number, number)], "k int, v int").coalesce(1)
        table.commit(batch, number)
        if number in (7, 12):
            table.commit(batch, number)          # not merged yet: takes the place of its first run
            table.commit(batch, number - 6)      # merged: left out
        assert len(folders(table)) <= 12
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert rows == {0: 21, 1: 22, 2: 20} | {100 + i: i for i in range(23)}
    assert len(table._names("manifest-")) == 2 and not table._names("_draft")


def test_a_failed_merge_leaves_the_table_as_it_was(spark, monkeypatch):
    table = BatchTable(spark, run_folder(spark, "failed"), ["k"], merge_every=3)
    for number in range(2):
        table.commit(spark.createDataFrame([(1, number)], "k int, v int"), number)
    publish, calls = table._publish, []

    def fails(manifest):
        calls.append(manifest)
        if manifest.merged:
            raise OSError("lost")
        publish(manifest)

    monkeypatch.setattr(table, "_publish", fails)
    with pytest.raises(OSError):
        table.commit(spark.createDataFrame([(1, 2)], "k int, v int"), 2)
    assert [tuple(r) for r in table.read().select("k", "v").collect()] == [(1, 2)]
    monkeypatch.undo()
    table.commit(spark.createDataFrame([(1, 3)], "k int, v int"), 3)
    assert table.manifest().upto == 3 and [tuple(r) for r in table.read().select("k", "v").collect()] == [(1, 3)]


SCORED = "ts timestamp, step long, text string, outcome int"


def answers(spark, path, rows):
    spark.createDataFrame(
        [(START + dt.timedelta(minutes=m), step, text, y) for m, step, text, y in rows], SCORED
    ).coalesce(1).write.mode("append").parquet(path)


def scored(df):
    reward = score_reward_fn()(F.col("text"), F.col("outcome"))
    return df.select("ts", "step", reward.alias("reward"), "outcome", F.length("text").alias("chars"))


def test_drain_equals_the_batch_and_survives_restarts(spark):
    source, folder = run_folder(spark, "answers"), run_folder(spark, "drain")
    rows = [(m, m // 60, "no idea" if m % 7 == 0 else f"Final: {m * 37 % 101}%", m % 2) for m in range(0, 600, 2)]
    rows += [(601, 10, f"Final: {i}%", 1) for i in range(19)] + [(602, 11, "nothing", 0)]
    for begin in range(0, len(rows), 110):   # a new query each time goes on from the state of the last
        answers(spark, source, rows[begin:begin + 110])
        stream = spark.readStream.schema(SCORED).parquet(source)
        figures = drain.drained_telemetry(scored(stream), lateness="10 minutes", patience_seconds=1800)
        query = drain.start_drain(figures, f"{folder}/table", f"{folder}/state", merge_every=3)
        query.awaitTermination()
        assert query.exception() is None
    got = {r["step"]: r for r in drain.latest_figures(spark, f"{folder}/table").collect()}
    batch = spark.read.parquet(source)
    want = {r["step"]: r for r in reward_telemetry(scored(batch)).collect()}
    assert got.keys() == want.keys() and len(got) == 12
    for step, row in want.items():
        for name in drain.FIGURES:
            assert got[step][name] == (None if row[name] is None else pytest.approx(row[name], abs=1e-12)), (step, name)
    assert got[10]["batch_ece"] is None and got[9]["batch_ece"] is not None
    closed = [step for step, row in got.items() if row["closed"]]
    assert closed and max(closed) < 10 and not got[11]["closed"]
