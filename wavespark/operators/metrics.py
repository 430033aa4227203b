"""Scores of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import median


def scores(rows: DataFrame, target: str, predicted: str, by: list[str] | None = None, epsilon: float = 0.0) -> DataFrame:
    """nmae and nmse: absolute and squared errors over those of the scored rows' mean target; n rows. Two passes, as the
    mean comes first; null where the target is constant and epsilon is 0. Rows without target or prediction are left
    out."""
    by = by or []
    rows = rows.where(F.col(target).isNotNull() & F.col(predicted).isNotNull())
    means = rows.groupBy(*by).agg(F.avg(target).alias("_mean"))
    rows = rows.join(means, by) if by else rows.crossJoin(F.broadcast(means))  # one row
    y, p, m = F.col(target), F.col(predicted), F.col("_mean")
    ratio = lambda a, b: F.sum(a) / F.nullif(F.sum(b) + epsilon, F.lit(0.0))
    return rows.groupBy(*by).agg(
        ratio(F.abs(y - p), F.abs(y - m)).alias("nmae"), ratio((y - p) * (y - p), (y - m) * (y - m)).alias("nmse"), F.count("*").alias("n")
    )


def median_baseline(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """Scores of predicting the training rows' median."""
    return scores(test.withColumn("_median", F.lit(median(train, F.col(target)))), target, "_median")


def histogram(rows: DataFrame, column: str, first: float, step: float, bins: int) -> DataFrame:
    """Counts (k, n) by bins centred on first, first + step, ...; values outside are left out, and the upper edge of the
    last bin is in it."""
    at = (F.col(column) - (first - step / 2)) / step
    k = F.when(at == bins, bins - 1).otherwise(F.floor(at)).cast("int")
    return rows.where((at >= 0) & (at <= bins)).groupBy(k.alias("k")).agg(F.count("*").alias("n"))
