"""Operators in long form, one row a sample: frames, lags and joins that Catalyst plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A


def explode(df: DataFrame, column: str, name: str, key: str = "row_id") -> DataFrame:
    """Rows (key, pos, name) of an array column."""
    return df.select(key, F.posexplode(column).alias("pos", name))


def peak_morphology(windows: DataFrame, rate: float, key: str = "row_id", column: str = "w") -> DataFrame:
    """Peaks and troughs of each window: their numbers; mean and deviation of amplitude (over the trough before, else the
    one after), rise, fall and gap between peaks, in seconds; and the rate. Windows without a peak and a trough get 0.

    A peak finds its troughs by running frames over the window's samples, so each window is one partition of one sort.
    """
    s = explode(windows, column, "v", key)
    order = W.partitionBy(key).orderBy("pos")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    # What comes next is what came last in falling order: a frame that ends at the current row grows by one step a row.
    ahead = W.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, 0)
    before, after = F.lag("v").over(order), F.lead("v").over(order)
    s = s.select("*", ((F.col("v") > before) & (F.col("v") > after)).alias("peak"), ((F.col("v") < before) & (F.col("v") < after)).alias("trough"))
    trough = F.when(F.col("trough"), F.struct("pos", "v"))
    s = s.select(
        "*", F.last(trough, ignorenulls=True).over(so_far).alias("prev"), F.last(trough, ignorenulls=True).over(ahead).alias("next"),
        F.last(F.when(F.col("peak"), F.col("pos")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)).alias("last"),
    )
    at_peak = lambda c: F.when(F.col("peak"), c)
    amp = at_peak(F.col("v") - F.coalesce("prev.v", "next.v"))
    rise, fall, gap = (at_peak(c / F.lit(float(rate))) for c in (F.col("pos") - F.col("prev.pos"), F.col("next.pos") - F.col("pos"), F.col("pos") - F.col("last")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return s.groupBy(key).agg(
        F.count_if("peak").cast("double").alias("peaks"), F.count_if("trough").cast("double").alias("troughs"),
        zero(F.avg(amp)).alias("amp_mean"), zero(F.stddev_pop(amp)).alias("amp_std"), zero(F.avg(rise)).alias("rise_mean"), zero(F.stddev_pop(rise)).alias("rise_std"),
        zero(F.avg(fall)).alias("fall_mean"), zero(F.stddev_pop(fall)).alias("fall_std"), zero(F.avg(rise) / (F.avg(fall) + 1e-8)).alias("rise_fall"),
        zero(F.avg(gap)).alias("gap_mean"), zero(F.stddev_pop(gap)).alias("gap_std"), zero(F.stddev_pop(gap) / (F.avg(gap) + 1e-8)).alias("gap_cv"),
        zero(60 / (F.avg(gap) + 1e-8)).alias("bpm"),
    )


def periodogram(windows: DataFrame, bpm: Sequence[float], rate: float, key: str = "row_id", column: str = "w", length: int = 64) -> DataFrame:
    """Power (key, k, power) of the centred, Hann-weighted windows at each rate: the matrix product as a join with the
    table of basis values and a sum. The table has length * len(bpm) rows, a fixed size, so it is broadcast; sums
    combine before they are shuffled."""
    spark = windows.sparkSession
    basis = [
        (n, k, hann * math.cos(2 * math.pi * f / 60 * n / rate), hann * math.sin(2 * math.pi * f / 60 * n / rate))
        for n in range(length) for hann in [0.5 - 0.5 * math.cos(2 * math.pi * n / (length - 1))] for k, f in enumerate(bpm)
    ]
    table = F.broadcast(spark.createDataFrame(basis, "pos int, k int, c double, s double"))
    x = F.col(column)
    centred = windows.select(key, A.let(A.mean(x), lambda m: F.transform(x, lambda v: v - m)).alias("x"))
    sums = explode(centred, "x", "v", key).join(table, "pos").groupBy(key, "k").agg(F.sum(F.col("v") * F.col("c")).alias("c"), F.sum(F.col("v") * F.col("s")).alias("s"))
    return sums.select(key, "k", (F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("power"))
