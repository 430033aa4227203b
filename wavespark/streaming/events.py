"""Windowed aggregates and recursive state over event streams, an extension beyond the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of event files as a stream, with ts as a timestamp."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_stats(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation and extremes of each subject's values in tumbling, or with slide sliding, windows."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = events.withWatermark("ts", late).groupBy(window.alias("w"), "user_id")
    found = grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean", "std", "low", "high")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def ewma(events: DataFrame, half_life: float) -> DataFrame:
    """The running level and deviation of each subject's values after each micro-batch, as arrays.ewma folds a window.
    State is four numbers a subject. Within a batch events are taken in the order of ts and event_id; a batch must not
    hold events older than those before it."""
    keep = 0.5 ** (1 / half_life)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, var, n = state.get if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        for x in rows["value"].tolist():
            if level is None:
                level = x
            else:
                level = keep * level + (1 - keep) * x
                var = keep * var + (1 - keep) * (x - level) ** 2
            n += 1
        state.update((level, var, n))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "level": [level], "std": [(var + 1e-12) ** 0.5]})

    out = "user_id long, n long, level double, std double"
    return events.groupBy("user_id").applyInPandasWithState(fold, out, "level double, var double, n long", "update", GroupStateTimeout.NoTimeout)
