"""Table functions for SQL: a window in, rows out. After register(spark), FROM windows, LATERAL sub_windows(w, 192, 64)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="k int, start int, part array<double>", useArrow=True)
class SubWindows:
    """The stretches of width samples of a window, step apart, that lie in it as a whole. A null or shorter window has none."""

    def eval(self, w: list, width: int, step: int) -> Iterator[tuple]:
        if width < 1 or step < 1:
            raise ValueError("width and step must be positive")
        if w is None:
            return
        for k, start in enumerate(range(0, len(w) - width + 1, step)):
            yield k, start, w[start : start + width]


@F.udtf(returnType="bpm double, power double, share double", useArrow=True)
class Evidence:
    """For each candidate from low to high beats a minute, step apart: the power of the window, less its mean and under a Hann
    taper, at that frequency, and its share of all candidates' power. rate is in samples a second."""

    def eval(self, w: list, rate: float, low: float, high: float, step: float) -> Iterator[tuple]:
        if w is None or not len(w):
            return
        x = np.asarray(w, float)
        t = np.arange(len(x))
        x = (x - x.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * t / max(len(x) - 1, 1)))
        bpm = low + step * np.arange(int(np.floor((float(high) - float(low)) / float(step) + 1e-9)) + 1)
        power = np.abs(np.exp(-2j * np.pi * np.outer(bpm / 60, t / float(rate))) @ x) ** 2
        yield from zip(bpm.tolist(), power.tolist(), (power / (power.sum() + 1e-20)).tolist(), strict=True)


def register(spark: SparkSession) -> None:
    spark.udtf.register("sub_windows", SubWindows)
    spark.udtf.register("evidence", Evidence)
