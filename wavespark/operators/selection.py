"""Choice of columns and blocks by held-out error, and reports on weights: from one set of sums, whatever is tried."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, splits
from .gram import Normal
from .joins import fold_of
from .linear import Fit, Linear, block_ridges, clip_range, predictions, ridge_path, scored
from .ordered import durable
from .quantiles import exact_quantiles

#: A multiplier of the penalty that takes a block out of a model.
OFF = 1e9


@dataclass
class Choice:
    """Columns (all, if None) and a multiplier of the penalty for each column."""

    label: str
    multipliers: np.ndarray
    columns: np.ndarray | None = None


def best_of_choices(train: Normal, held: DataFrame, choices: Sequence[Choice], penalties: Sequence[float], x: str = "x", y: str = "y") -> list[tuple[float, float, Linear]]:
    """For each choice the least nmae on the held-out rows over the path of penalties, its penalty and its model. All models
    of all choices come from the sums of the training rows and are scored in one pass."""
    p, models = train.width, []
    for c in choices:
        columns = np.arange(p) if c.columns is None else c.columns
        for m in ridge_path(train.columns(columns), penalties, 1 / np.sqrt(c.multipliers[columns]), centre=False):
            coef = np.zeros(p)
            coef[columns] = m.coef
            models.append(Linear(m.intercept, coef))
    errors = np.array([nmae for nmae, _ in scored(held, models, x, y)]).reshape(len(choices), len(penalties))
    best = errors.argmin(axis=1)
    return [(float(errors[k, j]), float(penalties[j]), models[k * len(penalties) + j]) for k, j in enumerate(best.tolist())]


def ablation(train: Normal, held: DataFrame, block_of: np.ndarray, configs: Sequence[tuple[str, Sequence[float]]], penalties: Sequence[float]) -> list[tuple[str, float, float]]:
    """(config, nmae, penalty) of each set of multipliers by block; OFF takes a block out."""
    found = best_of_choices(train, held, [Choice(label, np.asarray(m, float)[block_of]) for label, m in configs], penalties)
    return [(label, nmae, penalty) for (label, _), (nmae, penalty, _) in zip(configs, found, strict=True)]


def ranking(coef: np.ndarray) -> np.ndarray:
    """Columns by |weight|, the largest first; equal ones in their order."""
    return np.argsort(-np.abs(coef), kind="stable")


def sweep(train: Normal, held: DataFrame, multipliers: np.ndarray, penalties: Sequence[float], sizes: Sequence[int]) -> tuple[np.ndarray, list[tuple[int, float, float]]]:
    """The columns ranked by the weights of the best model of all of them; and for each size (number of first columns) its
    columns, nmae and penalty. The last row is of all columns."""
    p = train.width
    order = ranking(best_of_choices(train, held, [Choice("all", multipliers)], penalties)[0][2].coef)
    sizes = list(dict.fromkeys([*(min(k, p) for k in sizes), p]))
    found = best_of_choices(train, held, [Choice(str(k), multipliers, np.sort(order[:k])) for k in sizes], penalties)
    return order, [(k, nmae, penalty) for k, (nmae, penalty, _) in zip(sizes, found, strict=True)]


def select_by_weight(train: Normal, held: DataFrame, multipliers: np.ndarray, penalties: Sequence[float], sizes: Sequence[int] = (200, 300, 400, 600, 800, 1200)) -> np.ndarray:
    """The columns of the size of least held-out nmae, the first of equals, in their order."""
    order, found = sweep(train, held, multipliers, penalties, sizes)
    return np.sort(order[: min(found, key=lambda r: r[1])[0]])


def cross_validated(
    rows: DataFrame, n: int, p: int, block_of: np.ndarray, presets: Sequence[Sequence[float]], penalties: Sequence[float], folds: int = 5, key: str = "row_id", rounds: int = 3,
    clip: bool = True,
) -> DataFrame:
    """Out-of-fold predictions over contiguous folds of the rows 0..n-1: key, fold, y, p (clipped to what the fold's training
    targets allow) and middle, the median of these targets. Each fold is fitted as the final model is, its last quarter of
    training rows held out for the choice of penalties."""
    ends = splits.equal_parts(n, folds)
    starts = [0, *ends[:-1]]
    # Where a fold's held-out rows begin among its training rows, in all rows' numbers: those after the fold are further on by
    # its size. Between such cuts and the folds' ends all rows are used alike.
    cuts = [int((n - (b - a)) * 0.75) for a, b in zip(starts, ends, strict=True)]
    cuts = [c if c < a else c + b - a for c, a, b in zip(cuts, starts, ends, strict=True)]
    edges = sorted({0, *ends, *cuts} - {n})
    parts = list(zip(edges, [*edges[1:], n], strict=True))
    placed = durable(splits.contiguous(fold_of(rows, parts, key).withColumnRenamed("fold", "_part"), ends, key))
    fits = []
    for a, b, cut in zip(starts, ends, cuts, strict=True):
        outside = [k for k, (low, _) in enumerate(parts) if not a <= low < b]
        fits.append(Fit(frozenset(k for k in outside if parts[k][0] < cut), frozenset(k for k in outside if parts[k][0] >= cut)))
    models = block_ridges(placed, p, block_of, presets, penalties, fits, "_part", rounds=rounds)
    middles = exact_quantiles(placed, {str(k): F.when(F.col("fold") != k, F.col("y")) for k in range(folds)}, [0.5])
    spans = {r["fold"]: r for r in placed.groupBy("fold").agg(F.min("y").alias("a"), F.max("y").alias("b")).collect()}
    # One pass over the rows, each of which takes its fold's model and limits.
    limits = []
    for k in range(folds):
        others = [r for fold, r in spans.items() if fold != k]
        limits.append(clip_range(min(r["a"] for r in others), max(r["b"] for r in others)) if clip else (float("-inf"), float("inf")))
    own = lambda values: F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("fold"))
    p = F.get("p", F.col("fold"))
    value = F.greatest(own([low for low, _ in limits]), F.least(own([high for _, high in limits]), p))
    return predictions(placed, models).select(
        key, "fold", "y", F.when(F.isnan(p), own([m.intercept for m in models])).otherwise(value).alias("p"), own([middles[str(k)][0] for k in range(folds)]).alias("middle")
    )


def cross_validation_table(found: DataFrame) -> DataFrame:
    """Of cross_validated: nmae and nmse of the model and of the median, and the median, by fold ("1", ..), as their mean and
    population deviation over folds ("mean", "std"), and over all predictions together ("pooled")."""
    model, middle = (metrics.scores(found, "y", c, ["fold"]) for c in ("p", "middle"))
    names = ["nmae", "nmse", "median_nmae", "median_nmse", "median"]
    by_fold = model.join(middle.select("fold", F.col("nmae").alias("median_nmae"), F.col("nmse").alias("median_nmse")), "fold")
    by_fold = by_fold.join(found.groupBy("fold").agg(F.first("middle").alias("median")), "fold").select("fold", *names)
    by_fold = durable(by_fold)  # a row a fold, read three times
    over = lambda label, f: by_fold.agg(*[f(c).alias(c) for c in names]).select(F.lit(label).alias("fold"), *names)
    pooled, flat = (metrics.scores(found, "y", c) for c in ("p", "middle"))
    both = pooled.crossJoin(F.broadcast(flat.select(F.col("nmae").alias("median_nmae"), F.col("nmse").alias("median_nmse"))))  # one row each
    both = both.select(F.lit("pooled").alias("fold"), "nmae", "nmse", "median_nmae", "median_nmse", F.lit(None).cast("double").alias("median"))
    numbered = by_fold.select((F.col("fold") + 1).cast("string").alias("fold"), *names)
    return numbered.unionAll(over("mean", F.avg)).unionAll(over("std", F.stddev_pop)).unionAll(both)


def weights_table(rows: DataFrame) -> DataFrame:
    """Of columns (index, block, name, weight): by block their number, sum, mean and largest |weight| and share of all."""
    size = F.abs("weight")
    by = rows.groupBy("block").agg(F.count("*").alias("columns"), F.sum(size).alias("total"), F.avg(size).alias("mean"), F.max(size).alias("largest"))
    return by.crossJoin(F.broadcast(rows.agg(F.sum(size).alias("_all")))).withColumn("share", F.col("total") / F.col("_all")).drop("_all")  # one row


def grouped_weights(rows: DataFrame, group: Column) -> DataFrame:
    """Sum of |weight| by group, with its rank, the largest first."""
    found = rows.groupBy(group.alias("group")).agg(F.sum(F.abs("weight")).alias("total")).where("`group` IS NOT NULL")
    return found.orderBy(F.desc("total"), "group")


def largest_weights(rows: DataFrame, k: int) -> DataFrame:
    """The k columns of largest |weight|; equal ones in their order."""
    return rows.orderBy(F.desc(F.abs("weight")), "index").limit(k)
