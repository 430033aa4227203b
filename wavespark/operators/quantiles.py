"""Exact quantiles of many columns at once: each pass narrows a bracket around every order statistic that is asked for."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a pass, over all brackets: what comes to the driver has at most so many rows.
BINS = 1 << 17
MOST_BINS, LEAST_BINS = 1 << 14, 64


def ordered(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of the numbers."""
    bits = (values + 0.0).view(np.int64)  # -0.0 becomes 0.0
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def value_of(key: int) -> float:
    key = np.int64(key)
    return float((key ^ np.int64(0x7FFFFFFFFFFFFFFF) if key < 0 else key).view(np.float64))


def _counts(batches: Iterator[pa.RecordBatch], brackets: list[tuple[int, int, int]], bins: int) -> Iterator[pa.RecordBatch]:
    """How many values of each bracket (column, low, high) are in each of its bins, and the least and largest of them."""
    size = (len(brackets), bins)
    n, low, high = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
    for batch in batches:
        keys = {}
        for t, (c, a, b) in enumerate(brackets):
            if c not in keys:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                keys[c] = np.sort(ordered(v[np.isfinite(v)]))
            found = keys[c][np.searchsorted(keys[c], a) : np.searchsorted(keys[c], b, "right")]
            if not len(found):
                continue
            bin_ = ((found - np.int64(a)).view(np.uint64) // np.uint64(width_of(a, b, bins))).astype(np.int64)
            first = np.flatnonzero(np.r_[True, bin_[1:] != bin_[:-1]])
            last = np.r_[first[1:], len(found)] - 1
            at = bin_[first]
            n[t, at] += last - first + 1
            low[t, at] = np.minimum(low[t, at], found[first])
            high[t, at] = np.maximum(high[t, at], found[last])
    bracket, bin_ = np.nonzero(n)
    columns = bracket, bin_, n[bracket, bin_], low[bracket, bin_], high[bracket, bin_]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["bracket", "bin", "n", "low", "high"])


def width_of(a: int, b: int, bins: int) -> int:
    return (b - a) // bins + 1


def exact_quantiles(rows: DataFrame, columns: Mapping[str, Column], at: Sequence[float]) -> dict[str, list[float]]:
    """The quantiles of each column, interpolated between neighbours; NaN for one without a finite value. Missing and
    other values that are not finite are left out.

    Numbers are taken as integers in the same order. Each pass counts, for every bracket that still holds several
    values, how many are in each of its bins; the bin that has the wanted rank is the next bracket. Counts come from the
    tasks, a bounded number of rows whatever the table's size, so no task sorts or holds the values. Smooth columns need
    about three passes, so persist rows that are costly to make.
    """
    slim = rows.select(*[c.cast("double").alias(f"c{k}") for k, c in enumerate(columns.values())])
    names = list(columns)
    edge = np.iinfo(np.int64)
    # (column, rank) -> bracket and the rank within it; ranks are known once the first pass has counted the columns.
    brackets: dict[tuple[int, int], tuple[int, int, int]] = {}
    known: dict[tuple[int, int], float] = {}
    sizes, first = [0] * len(names), True
    while first or brackets:
        wanted = [(c, int(edge.min), int(edge.max)) for c in range(len(names))] if first else list(dict.fromkeys((c, a, b) for (c, _), (a, b, _) in brackets.items()))
        bins = max(LEAST_BINS, min(MOST_BINS, BINS // max(len(wanted), 1)))
        parts = slim.mapInArrow(lambda batches, w=wanted, bins=bins: _counts(batches, w, bins), "bracket long, bin long, n long, low long, high long")
        found = parts.groupBy("bracket", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["bracket", "bin"])
        by = {t: g for t, g in found.groupby("bracket")}
        if first:
            for c in range(len(names)):
                sizes[c] = int(by[c]["n"].sum()) if c in by else 0
                for q in at if sizes[c] else ():
                    place = int(np.floor(q * (sizes[c] - 1)))
                    for rank in (place, min(place + 1, sizes[c] - 1)):
                        brackets[c, rank] = (*wanted[c][1:], rank)
            first = False
        number = {w: t for t, w in enumerate(wanted)}
        for (c, rank), (a, b, inner) in list(brackets.items()):
            g = by[number[c, a, b]]
            ends = g["n"].to_numpy().cumsum()
            k = int(np.searchsorted(ends, inner, "right"))
            inner -= int(ends[k - 1]) if k else 0
            low, high, n = int(g["low"].iloc[k]), int(g["high"].iloc[k]), int(g["n"].iloc[k])
            if low == high or inner in (0, n - 1):
                known[c, rank] = value_of(low if inner == 0 else high)
                del brackets[c, rank]
            else:
                brackets[c, rank] = low, high, inner
    out = {}
    for c, name in enumerate(names):
        out[name] = []
        for q in at:
            if not sizes[c]:
                out[name].append(float("nan"))
                continue
            place = q * (sizes[c] - 1)
            rank = int(np.floor(place))
            a, b = known[c, rank], known[c, min(rank + 1, sizes[c] - 1)]
            out[name].append(a + (b - a) * (place - rank))
    return out


def median(rows: DataFrame, column: Column) -> float:
    return exact_quantiles(rows, {"v": column}, [0.5])["v"][0]
