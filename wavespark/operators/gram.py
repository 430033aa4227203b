"""Normal equations as distributed sums about the mean."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns up to which unweighted sums are plain aggregates; wider designs multiply batches as matrices.
NARROW = 12
#: Numbers in a block of matrix rows, the unit that is shuffled; and how many parts of a block one task adds up.
BLOCK, FAN_IN = 1 << 18, 8

PARTS = "key int, block int, slot int, weight double, mean array<double>, part array<double>"


@dataclass
class Normal:
    """Weighted sums over rows of columns x1..xp and a target: the rows' weight, the mean of each column (the target's is the
    last) and spread, the products of distances from the mean, (p + 1, p + 1). What is built from them cancels nothing,
    whatever the size of the means; gram, moment and squares are the plain sums with a column of ones in front."""

    weight: float
    mean: np.ndarray
    spread: np.ndarray

    @property
    def gram(self) -> np.ndarray:
        m = np.append(1.0, self.mean[:-1])
        out = self.weight * np.outer(m, m)
        out[1:, 1:] += self.spread[:-1, :-1]
        return out

    @property
    def moment(self) -> np.ndarray:
        out = self.weight * self.mean[-1] * np.append(1.0, self.mean[:-1])
        out[1:] += self.spread[:-1, -1]
        return out

    @property
    def squares(self) -> float:
        return float(self.spread[-1, -1] + self.weight * self.mean[-1] ** 2)

    @property
    def width(self) -> int:
        return len(self.mean) - 1

    @classmethod
    def of(cls, z: np.ndarray, weight: np.ndarray) -> Normal:
        """Of rows (columns, then the target)."""
        total = float(weight.sum())
        if not total:
            return cls(0.0, np.zeros(z.shape[1]), np.zeros((z.shape[1], z.shape[1])))
        mean = weight @ z / total
        away = z - mean
        mean = mean + (slip := weight @ away / total)
        return cls(total, mean, (away * weight[:, None]).T @ away - total * np.outer(slip, slip))

    def __add__(self, other: Normal) -> Normal:
        weight = self.weight + other.weight
        if not self.weight or not other.weight:
            return other if not self.weight else self
        apart = other.mean - self.mean
        return Normal(weight, self.mean + apart * (other.weight / weight), self.spread + other.spread + np.outer(apart, apart) * (self.weight * other.weight / weight))

    def __sub__(self, other: Normal) -> Normal:
        """The rest, when other is a part of this."""
        weight = self.weight - other.weight
        if not other.weight:
            return self
        if weight <= 0:
            return Normal(0.0, np.zeros_like(self.mean), np.zeros_like(self.spread))
        mean = self.mean + (self.mean - other.mean) * (other.weight / weight)
        apart = mean - other.mean
        return Normal(weight, mean, self.spread - other.spread - np.outer(apart, apart) * (weight * other.weight / self.weight))

    def columns(self, chosen: Sequence[int]) -> Normal:
        """The sums of some of the columns, and the target."""
        at = np.append(np.asarray(chosen, int), self.width)
        return Normal(self.weight, self.mean[at], self.spread[np.ix_(at, at)])

    def scaled(self, by: np.ndarray) -> Normal:
        """The sums of the columns times by, each."""
        s = np.append(by, 1.0)
        return Normal(self.weight, self.mean * s, self.spread * np.outer(s, s))

    def residual_squares(self, intercept: float, coef: np.ndarray) -> float:
        """The rows' squared distances from a linear model."""
        full = np.append(coef, -1.0)
        return float(full @ self.spread @ full + self.weight * (intercept + full @ self.mean) ** 2)


def _partial(batches: Iterator[pa.RecordBatch], p: int, variants: Callable[[np.ndarray], Iterator[np.ndarray]] | None, count: int, height: int) -> Iterator[pa.RecordBatch]:
    """Sums over a partition, one set a fold and variant of the design, sent in blocks of matrix rows."""
    sums: dict[int, Normal] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        fold = batch.column(0).to_numpy(zero_copy_only=False)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, p)
        y, weight = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        for k, design in enumerate(variants(x) if variants else [x]):
            z = np.column_stack([design, y])
            for f in np.unique(fold):
                at, key = fold == f, int(f) * count + k
                part = Normal.of(z[at], weight[at])
                sums[key] = sums[key] + part if key in sums else part
    slot = TaskContext.get().partitionId()
    for key, n in sums.items():
        for b, start in enumerate(range(0, p + 1, height)):
            rows = n.spread[start : start + height].ravel()
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([v], pa.int32()) for v in (key, b, slot)), pa.array([n.weight]), pa.array([n.mean], pa.list_(pa.float64())), pa.array([rows], pa.list_(pa.float64()))],
                ["key", "block", "slot", "weight", "mean", "part"],
            )


def _merged(group: pa.Table, p: int, height: int) -> pa.Table:
    """Some parts of the same block, as one."""
    weight = group["weight"].to_numpy()
    means = np.stack([np.asarray(m) for m in group["mean"].combine_chunks().to_pylist()])
    total = weight.sum()
    mean = weight @ means / total if total else means[0]
    start = group["block"][0].as_py() * height
    out = 0.0
    for j in range(group.num_rows):
        apart = means[j] - mean
        rows = group["part"].slice(j, 1).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1)
        out = out + rows + weight[j] * np.outer(apart[start : start + len(rows)], apart)
    return pa.table({
        "key": group["key"][:1], "block": group["block"][:1], "slot": pa.array([group["slot"][0].as_py()], pa.int32()), "weight": pa.array([total]),
        "mean": pa.array([mean], pa.list_(pa.float64())), "part": pa.array([out.ravel()], pa.list_(pa.float64())),
    })


def height_of(p: int, block: int = BLOCK) -> int:
    """Matrix rows in a block."""
    return max(1, block // (p + 1))


def partial_sums(slim: DataFrame, p: int, variants: Callable | None = None, count: int = 1, block: int = BLOCK) -> DataFrame:
    """What each task sends: blocks of its matrices. Input partitions are read by as many tasks as the cluster has cores, one
    after another (no shuffle), so the number of matrices follows the cores and not the input."""
    cores = slim.sparkSession.sparkContext.defaultParallelism
    height = height_of(p, block)
    return slim.coalesce(cores).mapInArrow(lambda batches: _partial(batches, p, variants, count, height), PARTS)


def reduced(parts: DataFrame, p: int, slots: int, block: int = BLOCK, fan_in: int = FAN_IN) -> DataFrame:
    """Parts added up in rounds of fan_in: a task holds fan_in blocks, and each round sends fan_in times less."""
    height = height_of(p, block)
    while slots > 1:
        slots = -(-slots // fan_in)
        merging = parts.withColumn("slot", F.floor(F.col("slot") / fan_in).cast("int"))
        parts = merging.groupBy("key", "block", "slot").applyInArrow(lambda group: _merged(group, p, height), PARTS)
    return parts


def normal_equations(
    rows: DataFrame, p: int, x: str = "x", y: str = "y", fold: str | None = None, weight: str | None = None,
    variants: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None, count: int = 1, block: int = BLOCK, fan_in: int = FAN_IN,
) -> dict[int, Normal]:
    """Sums for each fold (fold 0 if there is none). x is an array column of p doubles.

    Narrow unweighted designs are plain aggregates (means and covariances, which Spark combines without cancelling). Others
    are multiplied batch by batch, about the batch's mean; each core sends one matrix a fold in blocks of rows, and blocks
    are added up in rounds. What comes to the driver is folds * (p + 1) ** 2 numbers, whatever the rows.

    variants gives, for a batch of x, count designs of the same shape, all of them summed in the same pass; the sums of
    fold f and variant k are then found under f * count + k.
    """
    of = F.col(fold).cast("int") if fold else F.lit(0)
    slim = rows.select(of.alias("fold"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    out: dict[int, Normal] = {}
    if p <= NARROW and weight is None and variants is None:
        z = [*[F.get("x", F.lit(k)) for k in range(p)], F.col("y")]
        means = [F.avg(c) for c in z]
        pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
        found = slim.groupBy("fold").agg(F.count("*").alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(means)], *[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs])
        for r in found.collect():
            spread = np.zeros((p + 1, p + 1))
            for i, j in pairs:
                spread[i, j] = spread[j, i] = (r[f"c{i}_{j}"] or 0.0) * r["n"]
            out[r["fold"]] = Normal(float(r["n"]), np.array([r[f"m{i}"] or 0.0 for i in range(p + 1)]), spread)
        return dict(sorted(out.items()))
    height = height_of(p, block)
    parts = reduced(partial_sums(slim, p, variants, count, block), p, slim.sparkSession.sparkContext.defaultParallelism, block, fan_in)
    for r in parts.toLocalIterator():
        n = out.setdefault(r["key"], Normal(r["weight"], np.array(r["mean"]), np.zeros((p + 1, p + 1))))
        n.spread[r["block"] * height : (r["block"] + 1) * height] = np.array(r["part"]).reshape(-1, p + 1)
    return dict(sorted(out.items()))


def total(parts: dict[int, Normal]) -> Normal:
    out = None
    for part in parts.values():
        out = part if out is None else out + part
    return out
