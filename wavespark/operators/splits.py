"""Folds and splits."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .joins import fold_of, place_in_order


def contiguous(rows: DataFrame, ends: Sequence[int], key: str = "row_id") -> DataFrame:
    """Folds given by the exclusive end row of each."""
    return fold_of(rows, list(zip([0, *ends[:-1]], ends, strict=True)), key)


def equal_parts(n: int, folds: int) -> list[int]:
    """Exclusive ends of folds contiguous parts of n rows."""
    return np.linspace(0, n, folds + 1).astype(int)[1:].tolist()


def shuffled(rows: DataFrame, n: int, folds: int = 5, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Folds of a legacy NumPy permutation of n rows, as other tools draw them. The permutation is made on the driver and goes
    out as one small number a row, so it is meant for training tables; permuted() has no such bound. Rows whose key is no row
    number are left out."""
    order = np.random.RandomState(seed).permutation(n)
    fold = np.empty(n, np.min_scalar_type(-folds))
    for k, part in enumerate(np.array_split(order, folds)):
        fold[part] = k
    shared = rows.sparkSession.sparkContext.broadcast(fold)

    @F.arrow_udf("int")
    def fold_of_row(row: pa.Array) -> pa.Array:
        return pa.array(shared.value[row.to_numpy(zero_copy_only=False)], pa.int32())

    return rows.where((F.col(key) >= 0) & (F.col(key) < n)).withColumn("fold", fold_of_row(F.col(key).cast("long")))


def permutation(values: np.ndarray, n: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts each value: Feistel rounds on the least even number of bits that holds n - 1,
    repeated for results of n or more until they are below it, which a permutation's cycles reach."""
    half = max(1, -(-int(n - 1).bit_length() // 2))
    mask, keys = np.uint64((1 << half) - 1), np.random.SeedSequence(seed).generate_state(rounds, np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        for k in keys:
            x = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & mask)
        return (left << np.uint64(half)) | right

    out = once(values.astype(np.uint64))
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


def permuted(rows: DataFrame, n: int, folds: int = 5, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Folds of a shuffle of the row numbers 0..n-1 whose sizes differ by one at most, from each row's number alone: no
    permutation is stored, and nothing is shuffled. Rows whose key is no row number are left out."""
    least, larger = divmod(n, folds)

    @F.arrow_udf("int")
    def fold_of_row(row: pa.Array) -> pa.Array:
        place = permutation(row.to_numpy(zero_copy_only=False), n, seed)
        head = larger * (least + 1)
        fold = np.where(place < head, place // (least + 1), larger + (place - head) // max(least, 1))
        return pa.array(fold, pa.int32())

    return rows.where((F.col(key) >= 0) & (F.col(key) < n)).withColumn("fold", fold_of_row(F.col(key).cast("long")))


def hashed(rows: DataFrame, folds: int = 5, seed: int = 0, key: str = "row_id") -> DataFrame:
    """Folds by a hash of the key: for tables of any size."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int"))


def temporal(rows: DataFrame, subject: str, time: str, share: float = 0.75, key: str = "row_id") -> DataFrame:
    """Adds test, whether a row is among the latest of its subject: all but the first share of them, at least one row
    being left for training. Equal times keep the order of key."""
    return temporal_parts(rows, subject, time, [share], key).withColumn("test", F.col("part") > 0).drop("part")


def temporal_parts(rows: DataFrame, subject: str, time: str, shares: Sequence[float], key: str = "row_id") -> DataFrame:
    """Adds part, how many of the cuts a row is beyond, in the order of its subject's rows: the k-th cut is after that
    share of them, rounded down, and after k + 1 rows at least."""
    placed = place_in_order(rows, subject, time, key)
    beyond = [F.col("_place") > F.greatest(F.floor(F.col("_count") * share), F.lit(k + 1)) for k, share in enumerate(shares)]
    return placed.withColumn("part", sum(b.cast("int") for b in beyond)).drop("_place", "_count")


def leave_one_out(rows: DataFrame, subject: str, most: int = 8) -> DataFrame:
    """Adds fold, the rank of the row's subject among the first most subjects in order; null for rows of others, which
    are always for training."""
    first = rows.select(subject).distinct().orderBy(subject).limit(most)
    ranked = first.select(subject, (F.row_number().over(W.orderBy(subject)) - 1).alias("fold"))  # of at most most rows
    return rows.join(F.broadcast(ranked), subject, "left")


def head_tail(rows: DataFrame, n: int, share: float = 0.75, key: str = "row_id") -> DataFrame:
    return rows.withColumn("test", F.col(key) >= int(n * share))
