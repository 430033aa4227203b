"""Streams of a small folder of events against the same aggregates in batch."""

import pytest
from pyspark.sql import functions as F

from wavespark.functions import arrays as A
from wavespark.streaming import events as E


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = [(k, f"2024-01-01 {k // 60 % 24:02}:{k % 60:02}:00", k % 3, float((k * 37) % 50)) for k in range(240)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, value double")
    df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(path)
    return path


def drained(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
        return q.name
    finally:
        q.stop()


def test_windows_equal_batch(spark, folder):
    name = drained(E.windowed_stats(E.read_events(spark, folder), "1 hour"), "hours", "complete")
    got = {(r["user_id"], r["start"]): (r["n"], r["mean"]) for r in spark.table(name).collect()}
    batch = spark.read.parquet(folder).groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    assert got == {(r["user_id"], r["w"]["start"]): (r["n"], r["mean"]) for r in batch.collect()}


def test_ewma_state_equals_fold(spark, folder):
    name = drained(E.ewma(E.read_events(spark, folder), 8), "levels", "update")
    got = {r["user_id"]: r for r in spark.table(name).collect()}
    series = spark.read.parquet(folder).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    fold = A.ewma(F.transform("e", lambda e: e["value"]), 8)
    for r in series.select("user_id", fold["level"].alias("level"), fold["std"].alias("std")).collect():
        assert got[r["user_id"]]["level"] == pytest.approx(r["level"]) and got[r["user_id"]]["std"] == pytest.approx(r["std"])


def test_sliding_windows_and_sessions_equal_batch(spark, folder):
    name = drained(E.windowed_stats(E.read_events(spark, folder), "1 hour", "20 minutes"), "slides", "complete")
    batch = spark.read.parquet(folder).groupBy("user_id", F.window("ts", "1 hour", "20 minutes").alias("w")).agg(F.max("value").alias("high"))
    assert {(r["user_id"], r["start"]): r["high"] for r in spark.table(name).collect()} == {(r["user_id"], r["w"]["start"]): r["high"] for r in batch.collect()}
    name = drained(E.sessions(E.read_events(spark, folder), "2 minutes"), "parts", "complete")
    batch = spark.read.parquet(folder).groupBy("user_id", F.session_window("ts", "2 minutes").alias("w")).agg(F.sum("value").alias("total"))
    assert sorted((r["user_id"], r["start"], r["total"]) for r in spark.table(name).collect()) == sorted((r["user_id"], r["w"]["start"], r["total"]) for r in batch.collect())
