"""Choice of a transform inside cross-validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .gram import normal_equations, total
from .linear import Basis, Linear, left_out_errors, mse_of, predicted
from .ordered import durable

#: Bytes of matrices that the driver holds, and broadcasts, at once.
HELD = 1 << 28

#: Strengths and penalties of the published gate search.
STRENGTHS = tuple(np.linspace(0.0, 0.9, 19).tolist())
PENALTIES = tuple(np.logspace(-3, 3, 13).tolist())


class Stage(Protocol):
    """A transform of the design that keeps its width, for whole batches and as a plan."""

    def values(self, x: np.ndarray) -> np.ndarray: ...

    def apply(self, rows: DataFrame, x: str = "x") -> DataFrame: ...


@dataclass(frozen=True)
class Gate:
    """Columns that are correlations, amplified above a strength and damped below it; the others pass."""

    columns: tuple[int, ...]
    strength: float
    gain: float = 0.6
    steep: float = 12.0

    def values(self, x: np.ndarray) -> np.ndarray:
        out, at = x.copy(), list(self.columns)
        out[:, at] *= 1 + self.gain * np.tanh(self.steep * (np.abs(x[:, at]) - self.strength))
        return out

    def apply(self, rows: DataFrame, x: str = "x") -> DataFrame:
        return rows.withColumn(x, F.transform(x, lambda v, k: F.when(k.isin(*self.columns), A.gate(v, self.strength, self.gain, self.steep)).otherwise(v)))


@dataclass
class Found:
    """What a search found: each candidate's mean squared error over the folds and the penalty it takes on all rows, the
    number of the best candidate (the first of equals), and that one's model of all rows."""

    errors: list[float]
    penalties: list[float]
    best: int
    stage: Stage
    model: Linear

    def predict(self, rows: DataFrame, x: str = "x", name: str = "p") -> DataFrame:
        """Adds the prediction: the best stage is applied to a copy of the design."""
        return predicted(self.stage.apply(rows.withColumn("_gated", F.col(x)), "_gated"), self.model, "_gated", name).drop("_gated")


def alike_rows(rows: DataFrame, x: str = "x", y: str = "y", fold: str = "fold") -> DataFrame:
    """One row for each fold and distinct x: y is the mean of its rows' targets, weight their number, within the sum of their
    squared distances from it. Sums of squares over the rows follow from these exactly, whatever the model."""
    value = F.col(y).cast("double")
    found = rows.groupBy(F.col(fold).cast("int").alias(fold), F.col(x).cast("array<double>").alias(x)).agg(F.avg(value).alias(y), F.count("*").cast("double").alias("weight"), F.var_pop(value).alias("within"))
    return found.withColumn("within", F.col("within") * F.col("weight"))


def nested_search(
    rows: DataFrame, p: int, stages: Sequence[Stage], penalties: Sequence[float] = PENALTIES, x: str = "x", y: str = "y", fold: str = "fold", standardise: bool = True, held: int = HELD,
    alike: bool = False,
) -> Found:
    """Of candidate stages the one of least mean squared error over the folds, when each fold's model is a ridge on the
    transformed (and standardised) columns whose penalty is chosen by leave-one-out errors within the training rows.

    Two passes, whatever the folds, candidates and penalties: the first sums the normal equations of every candidate's
    design by fold; training sums are the total less a fold, and their eigenbases go out for the second, which adds up every
    row's leave-one-out errors in all fits that it takes part in. Errors on held-out folds come from the sums. A design so
    wide that all candidates' matrices would pass `held` bytes is done in groups of candidates, with two passes each.

    alike: for designs that take few distinct values, rows of the same fold and columns are put together first (see
    alike_rows), so that what is done for each candidate follows the distinct rows; every row is in the sums as before.

    Folds are numbers from 0; rows have values for all columns and a target. Persist rows that are costly to make.
    """
    rows = durable(alike_rows(rows, x, y, fold)) if alike else rows
    weight, within = ("weight", "within") if alike else (None, None)
    count_of = lambda n: max(1, held // (n * (p + 1) ** 2 * 8))
    apart = {r[0]: r[1] for r in rows.groupBy(F.col(fold).cast("int").alias(fold)).agg(F.sum(F.col(within) if alike else F.lit(0.0))).orderBy(fold).collect()}  # a few by nature
    folds = list(apart)
    if len(folds) < 2:
        raise ValueError("a search needs two folds at least")
    each = count_of(2 * len(folds) + 2)
    errors, taken, models = [], [], []
    for start in range(0, len(stages), each):
        group = list(stages[start : start + each])
        n = len(group)
        variants = lambda values, group=group: (stage.values(values) for stage in group)
        sums = normal_equations(rows, p, x, y, fold, weight, variants=variants, count=n)
        for key, part in sums.items():
            part.spread[-1, -1] += apart[key // n]
        bases = {}
        for k in range(n):
            everything = total({f: sums[f * n + k] for f in folds})
            # Fold -1 is none: the basis of all rows.
            bases[-n + k] = Basis.of(everything, standardise)
            for f in folds:
                bases[f * n + k] = Basis.of(everything - sums[f * n + k], standardise)
        found = left_out_errors(rows, bases, penalties, lambda basis, row: basis != row, x, y, fold, variants, n, weight, within)
        penalty = {key: float(penalties[int(e.argmin())]) for key, e in found.items()}
        for k in range(n):
            errors.append(float(np.mean([mse_of(sums[f * n + k], bases[f * n + k].model(penalty[f * n + k])) for f in folds])))
            taken.append(penalty[k - n])
            models.append(bases[k - n].model(penalty[k - n]))
    best = int(np.argmin(errors))
    return Found(errors, taken, best, stages[best], models[best])
