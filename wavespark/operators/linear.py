"""Closed-form linear models. Rows stay distributed; what is solved on the driver is the size of the design's width."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as A
from .gram import Normal, normal_equations, total
from .quantiles import median

LAMBDAS_C = tuple(10.0 ** np.arange(-0.5, 6.01, 0.25))
LAMBDAS_D = tuple(10.0 ** np.arange(-1, 5.01, 0.5))

#: Columns up to which a prediction is a sum of products.
NARROW = 32


@dataclass
class Linear:
    intercept: float
    coef: np.ndarray

    def predict(self, x: str = "x") -> Column:
        """Of a narrow design as a sum of products, which generated code runs; of a wide one as a fold over arrays."""
        if len(self.coef) <= NARROW:
            return sum((F.get(x, F.lit(j)) * float(c) for j, c in enumerate(self.coef)), F.lit(float(self.intercept)))
        return A.dot(F.col(x), A.constant(self.coef)) + float(self.intercept)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, b, rcond=None)[0]


def _fitted(normal: Normal, gram: np.ndarray, scale: np.ndarray) -> Linear:
    coef = scale * _solve(gram, normal.spread[:-1, -1] * scale)
    return Linear(float(normal.mean[-1] - normal.mean[:-1] @ coef), coef)


def ols(normal: Normal) -> Linear:
    return _fitted(normal, normal.spread[:-1, :-1], np.ones(normal.width))


def ridge(normal: Normal, penalty: float, scale: np.ndarray | None = None) -> Linear:
    """The penalty isn't scaled by the number of rows, and the intercept isn't penalised. scale multiplies columns before
    the penalty is applied: a penalty m times as large for a block is a scale of 1 / sqrt(m)."""
    s = np.ones(normal.width) if scale is None else np.asarray(scale, float)
    return _fitted(normal, normal.spread[:-1, :-1] * np.outer(s, s) + penalty * np.eye(len(s)), s)


def centred(normal: Normal) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gram and moment of the centred columns, with the means of columns and target."""
    return normal.spread[:-1, :-1], normal.spread[:-1, -1], normal.mean[:-1], float(normal.mean[-1])


def about_mean(normal: Normal) -> tuple[np.ndarray, np.ndarray, float]:
    """Gram of the columns as they are and moment with the target less its mean: the form of models whose intercept is the
    target's (weighted) mean and whose columns were standardised beforehand."""
    mean = normal.mean[:-1]
    return normal.spread[:-1, :-1] + normal.weight * np.outer(mean, mean), normal.spread[:-1, -1], float(normal.mean[-1])


def ridge_path(normal: Normal, penalties: Sequence[float], scale: np.ndarray | None = None, centre: bool = True) -> list[Linear]:
    """All penalties from one eigendecomposition. centre=False takes the columns as they are and the target's mean as
    intercept, see about_mean."""
    if centre:
        gram, moment, mean, level = centred(normal)
    else:
        gram, moment, level = about_mean(normal)
        mean = np.zeros(len(moment))
    s = np.ones(len(mean)) if scale is None else scale
    values, vectors = np.linalg.eigh(gram * np.outer(s, s))
    projected = vectors.T @ (moment * s)
    out = []
    for penalty in penalties:
        w = s * (vectors @ (projected / (np.maximum(values, 0) + penalty)))
        out.append(Linear(level - float(mean @ w), w))
    return out


#: Coefficients, over all models, up to which predictions are expressions; more are a product of matrices a batch.
FEW = 256


def _products(batches: Iterator[pa.RecordBatch], coef: np.ndarray, intercept: np.ndarray, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, coef.shape[1])
        p = x @ coef.T + intercept
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(intercept)), pa.array(p.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "p"])


def predictions(rows: DataFrame, models: Sequence[Linear], x: str = "x") -> DataFrame:
    """Adds p, an array of each model's prediction, in one pass. All rows have values for all columns."""
    rows = rows.drop("p")
    if sum(len(m.coef) for m in models) <= FEW:
        return rows.withColumn("p", F.array(*[m.predict(x) for m in models]))
    coef, intercept = np.stack([m.coef for m in models]), np.array([m.intercept for m in models])
    rows = rows.withColumn(x, F.col(x).cast("array<double>"))
    schema = T.StructType([*rows.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])
    shared = rows.sparkSession.sparkContext.broadcast((coef, intercept))
    at = rows.columns.index(x)
    return rows.mapInArrow(lambda batches: _products(batches, *shared.value, at), schema)


def _moved(batches: Iterator[pa.RecordBatch], mean: np.ndarray, scale: np.ndarray, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = (batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(mean)) - mean) * scale
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(mean)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:at], lists, *batch.columns[at + 1 :]], batch.schema.names)


def moved(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, x: str = "x") -> DataFrame:
    """x less mean, times scale: of a narrow design as an expression, of a wide one batch by batch."""
    if len(mean) <= NARROW:
        return rows.withColumn(x, F.array(*[(F.get(x, F.lit(j)) - float(m)) * float(s) for j, (m, s) in enumerate(zip(mean, scale, strict=True))]))
    rows = rows.withColumn(x, F.col(x).cast("array<double>"))
    at = rows.columns.index(x)
    return rows.mapInArrow(lambda batches: _moved(batches, mean, scale, at), rows.schema)


def predicted(rows: DataFrame, model: Linear, x: str = "x", name: str = "p") -> DataFrame:
    """Adds one model's prediction."""
    return predictions(rows, [model], x).withColumn(name, F.get("p", F.lit(0)))


@dataclass
class Trial:
    """Models to be scored on the rows of some groups; mean is the mean of these rows' target."""

    groups: frozenset[int]
    models: Sequence[Linear]
    mean: float


def _errors(batches: Iterator[pa.RecordBatch], trials: list[tuple[list[int], np.ndarray, np.ndarray, float]]) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task and each trial: how far each model's predictions, and the mean, are from the target, plainly and
    squared."""
    totals = [np.zeros((4, len(intercept))) for _, _, intercept, _ in trials]
    for batch in batches:
        if not batch.num_rows:
            continue
        group, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        for total, (groups, coef, intercept, mean) in zip(totals, trials, strict=True):
            at = np.isin(group, groups)
            off, base = x[at] @ coef.T + intercept - y[at, None], (y[at] - mean)[:, None]
            for k, values in enumerate((np.abs(off), off**2, np.abs(base), base**2)):
                total[k] += values.sum(axis=0)
    number = np.concatenate([np.full(t.shape[1], k) for k, t in enumerate(totals)])
    model = np.concatenate([np.arange(t.shape[1]) for t in totals])
    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(model), *map(pa.array, np.concatenate(totals, axis=1))], ["t", "k", "a", "s", "base_a", "base_s"])


def scored_trials(rows: DataFrame, trials: Sequence[Trial], group: str | None = None, x: str = "x", y: str = "y") -> list[list[tuple[float, float]]]:
    """nmae and nmse of each trial's models over its groups' rows, all trials in one pass; a task sends one row a model.
    Without a group column all rows are of group 0."""
    packed = [(sorted(t.groups), np.stack([m.coef for m in t.models]), np.array([m.intercept for m in t.models]), t.mean) for t in trials]
    shared = rows.sparkSession.sparkContext.broadcast(packed)
    slim = rows.select((F.col(group).cast("int") if group else F.lit(0)).alias("g"), F.col(x).cast("array<double>"), F.col(y).cast("double"))
    parts = slim.mapInArrow(lambda batches: _errors(batches, shared.value), "t long, k long, a double, s double, base_a double, base_s double")
    found = parts.groupBy("t", "k").agg((F.sum("a") / F.sum("base_a")).alias("nmae"), (F.sum("s") / F.sum("base_s")).alias("nmse")).collect()
    out: list[list[tuple[float, float]]] = [[] for _ in trials]
    for r in sorted(found, key=lambda r: (r["t"], r["k"])):
        out[r["t"]].append((r["nmae"], r["nmse"]))
    return out


def scored(rows: DataFrame, models: Sequence[Linear], x: str = "x", y: str = "y", mean: float | None = None) -> list[tuple[float, float]]:
    """nmae and nmse of each model over rows, in one pass whatever their number. mean: of the rows' target, if it is known."""
    mean = rows.agg(F.avg(y)).first()[0] if mean is None else mean
    return scored_trials(rows, [Trial(frozenset([0]), models, mean)], None, x, y)[0]


def nmse_of(part: Normal, model: Linear) -> float:
    """nmse over the rows that were summed, from their sums alone."""
    return part.residual_squares(model.intercept, model.coef) / float(part.spread[-1, -1])


def mse_of(part: Normal, model: Linear) -> float:
    return part.residual_squares(model.intercept, model.coef) / part.weight


def ridge_cv(
    rows: DataFrame, p: int, penalties: Sequence[float], x: str = "x", y: str = "y", fold: str = "fold", error: Callable[[Normal, Linear], float] = nmse_of
) -> tuple[list[float], int, Linear]:
    """Mean over folds of each penalty's error (nmse, or mse_of) on the held-out fold, the index of the best (the first of
    equals) and the model of all rows with it. One pass sums the folds' normal equations: training sums are the total less
    the fold, and a fold's squared errors come from its sums."""
    return ridge_choice(normal_equations(rows, p, x, y, fold), penalties, error)


def ridge_choice(parts: dict[int, Normal], penalties: Sequence[float], error: Callable[[Normal, Linear], float] = nmse_of) -> tuple[list[float], int, Linear]:
    """ridge_cv from the folds' sums alone."""
    everything = total(parts)
    paths = [(part, ridge_path(everything - part, penalties)) for part in parts.values()]
    errors = [float(np.mean([error(part, path[k]) for part, path in paths])) for k in range(len(penalties))]
    best = int(np.argmin(errors))
    return errors, best, ridge(everything, penalties[best])


def irls(
    rows: DataFrame, p: int, penalty: float, start: Linear, rounds: int = 3, floor_add: float = 1e-3, held: Column | None = None, x: str = "x", y: str = "y",
    weighted_level: bool = False,
) -> Linear:
    """Towards least absolute errors: rows are weighted by 1 / max(|residual|, floor), the floor being 1.345 times the
    median distance of residuals from their median, plus floor_add; the penalty is scaled by the mean weight. The columns
    are taken as they are; the intercept is the target's mean, the weighted one with weighted_level. Of all rounds and
    the start, the model of least nmae on the rows that held selects (all, if None) stays.

    Each round sums once, scores once, and takes some passes over the residuals alone for the medians."""
    if not rounds:
        return start
    tested = rows if held is None else rows.where(held)
    mean = tested.agg(F.avg(y)).first()[0]
    best, best_score, model = start, scored(tested, [start], x, y, mean)[0][0], start
    plain = rows.agg(F.avg(y)).first()[0]
    for _ in range(rounds):
        residual = predicted(rows.select(x, y), model, x).select(x, y, (F.col(y) - F.col("p")).alias("_r")).persist()
        middle = median(residual, F.col("_r"))
        floor = 1.345 * median(residual, F.abs(F.col("_r") - middle)) + floor_add
        sums = normal_equations(residual.withColumn("_w", 1 / F.greatest(F.abs("_r"), F.lit(floor))), p, x, y, weight="_w")[0]
        n = residual.count()
        residual.unpersist()
        gram, moment, level = about_mean(sums)
        if not weighted_level:
            moment, level = moment + (level - plain) * sums.weight * sums.mean[:-1], plain
        model = Linear(level, _solve(gram + penalty * sums.weight / n * np.eye(p), moment))
        if (now := scored(tested, [model], x, y, mean)[0][0]) < best_score:
            best, best_score = model, now
    return best


def elastic_net(normal: Normal, alpha: float, l1_ratio: float, start: np.ndarray | None = None, tol: float = 1e-7, rounds: int = 2000) -> Linear:
    """Coordinate descent on the centred Gram: least 1/(2n) |y - Xw|^2 + alpha (l1_ratio |w|_1 + (1 - l1_ratio)/2 |w|^2)."""
    gram, moment, mean, y_mean = centred(normal)
    n = normal.weight
    gram, moment = gram / n, moment / n
    w = np.zeros(len(moment)) if start is None else start.copy()
    fit = gram @ w
    hard, soft = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(rounds):
        most = 0.0
        for j in range(len(w)):
            if gram[j, j] == 0:
                continue
            r = moment[j] - fit[j] + gram[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - hard, 0) / (gram[j, j] + soft)
            if new != w[j]:
                fit += gram[:, j] * (new - w[j])
                most = max(most, abs(new - w[j]) * np.sqrt(gram[j, j]))
                w[j] = new
        if most < tol:
            break
    return Linear(y_mean - float(mean @ w), w)


def elastic_net_cv(parts: dict[int, Normal], alphas: Sequence[float], ratios: Sequence[float]) -> tuple[float, float, Linear]:
    """Alpha and l1 ratio of least mean squared error over the folds, whose errors come from their sums alone; no further
    pass over the rows is made. Alphas are followed from the largest down, each starting from the one before."""
    everything = total(parts)
    best = None
    for ratio in ratios:
        errors = {a: 0.0 for a in alphas}
        for part in parts.values():
            train, w = everything - part, None
            for a in sorted(alphas, reverse=True):
                model = elastic_net(train, a, ratio, w)
                w = model.coef
                errors[a] += mse_of(part, model) / len(parts)
        for a, e in errors.items():
            if best is None or e < best[0]:
                best = e, a, ratio
    return best[1], best[2], elastic_net(everything, best[1], best[2])


@dataclass
class Basis:
    """A fitted ridge path over the rows that were summed, in the form that leave-one-out errors need: columns less mean over
    scale, turned by vectors, have these values (the eigenvalues) and projections of the target."""

    n: float
    mean: np.ndarray
    scale: np.ndarray
    level: float
    values: np.ndarray
    vectors: np.ndarray
    projected: np.ndarray

    @classmethod
    def of(cls, normal: Normal, standardise: bool = False) -> Basis:
        """standardise: columns by their deviation; a constant one is left as it is."""
        scale = np.sqrt(np.maximum(np.diag(normal.spread)[:-1], 0) / normal.weight) if standardise else np.ones(normal.width)
        scale = np.where(scale > 0, scale, 1.0)
        values, vectors = np.linalg.eigh(normal.spread[:-1, :-1] / np.outer(scale, scale))
        return cls(normal.weight, normal.mean[:-1], scale, float(normal.mean[-1]), np.maximum(values, 0), vectors, vectors.T @ (normal.spread[:-1, -1] / scale))

    def errors(self, x: np.ndarray, y: np.ndarray, penalties: np.ndarray, weight: np.ndarray, within: np.ndarray) -> np.ndarray:
        """Summed squared errors of rows that were fitted, each left out of the fit, for each penalty. A row stands for weight
        rows of the same columns, whose targets have the mean y and within as squared distances from it."""
        turned = ((x - self.mean) / self.scale) @ self.vectors
        shrunk = 1 / np.maximum(self.values[:, None] + penalties, 1e-300)
        residual = y[:, None] - self.level - turned @ (self.projected[:, None] * shrunk)
        return ((weight[:, None] * residual**2 + within[:, None]) / (1 - (turned * turned) @ shrunk - 1 / self.n) ** 2).sum(axis=0)

    def model(self, penalty: float) -> Linear:
        coef = self.vectors @ (self.projected / np.maximum(self.values + penalty, 1e-300)) / self.scale
        return Linear(self.level - float(self.mean @ coef), coef)


def _left_out(batches: Iterator[pa.RecordBatch], bases: dict[int, Basis], penalties: np.ndarray, own: Callable[[int, int], bool], variants: Callable | None, count: int) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task: the summed squared errors of each basis (whose key is fold * count + variant) over the rows that
    it was fitted on, which own(fold of the basis, fold of the row) tells."""
    sums = {key: np.zeros(len(penalties)) for key in bases}
    for batch in batches:
        if not batch.num_rows:
            continue
        fold, y, weight, within = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for k, design in enumerate(variants(x) if variants else [x]):
            for key, basis in bases.items():
                if key % count == k:
                    at = np.isin(fold, [f for f in np.unique(fold) if own(key // count, int(f))])
                    sums[key] += basis.errors(design[at], y[at], penalties, weight[at], within[at])
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["key", "e"])


def left_out_errors(
    rows: DataFrame, bases: dict[int, Basis], penalties: Sequence[float], own: Callable[[int, int], bool], x: str = "x", y: str = "y", fold: str | None = None,
    variants: Callable | None = None, count: int = 1, weight: str | None = None, within: str | None = None,
) -> dict[int, np.ndarray]:
    """Mean squared leave-one-out errors by basis and penalty, in one pass; a task sends one row a basis. weight, within: see
    Basis.errors; rows stand for themselves if they are not given."""
    shared = rows.sparkSession.sparkContext.broadcast((bases, np.asarray(penalties, float)))
    slim = rows.select((F.col(fold).cast("int") if fold else F.lit(0)).alias("fold"), F.col(x).cast("array<double>"), F.col(y).cast("double"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), (F.col(within).cast("double") if within else F.lit(0.0)).alias("within"))
    parts = slim.mapInArrow(lambda batches: _left_out(batches, *shared.value, own, variants, count), "key int, e array<double>")
    found = parts.groupBy("key").agg(*[F.sum(F.get("e", F.lit(j))).alias(f"e{j}") for j in range(len(penalties))]).collect()
    return {r["key"]: np.array(r[1:]) / bases[r["key"]].n for r in found}


def leave_one_out(rows: DataFrame, normal: Normal, penalties: Sequence[float], x: str = "x", y: str = "y") -> list[float]:
    """Mean squared leave-one-out error of each penalty, by the hat matrix's diagonal: one pass for all of them, a product of
    matrices a batch."""
    found = left_out_errors(rows, {0: Basis.of(normal)}, penalties, lambda basis, row: True, x, y)
    return found[0].tolist() if found else [float("nan")] * len(penalties)


@dataclass
class Fit:
    """A choice by held-out rows: the groups whose rows are fitted, and those that are held out."""

    train: frozenset[int]
    held: frozenset[int]


def block_ridges(
    rows: DataFrame, p: int, block_of: np.ndarray, presets: Sequence[Sequence[float]], penalties: Sequence[float], fits: Sequence[Fit], group: str, x: str = "x", y: str = "y", rounds: int = 3
) -> list[Linear]:
    """block_ridge for several fits over groups of the same rows: one pass sums all groups, one scores all models of all fits;
    only the reweighting, if any, goes fit by fit."""
    parts = normal_equations(rows, p, x, y, group)
    of = lambda groups: total({g: n for g, n in parts.items() if g in groups})
    scale_of = lambda preset: 1 / np.sqrt(np.asarray(preset, float)[block_of])
    trials = []
    for fit in fits:
        train, held = of(fit.train), of(fit.held)
        if train is None or held is None:
            raise ValueError("some rows must be held out, and some not")
        trials.append(Trial(fit.held, [m for preset in presets for m in ridge_path(train, penalties, scale_of(preset), centre=False)], float(held.mean[-1])))
    out = []
    for fit, errors in zip(fits, scored_trials(rows, trials, group, x, y), strict=True):
        best = int(np.argmin([nmae for nmae, _ in errors]))
        penalty, scale = penalties[best % len(penalties)], scale_of(presets[best // len(penalties)])
        gram, moment, level = about_mean(of(fit.train | fit.held))
        model = Linear(level, _solve(gram * np.outer(scale, scale) + penalty * np.eye(p), moment * scale))
        if rounds:
            scaled = moved(rows.where(F.col(group).isin(*fit.train | fit.held)), np.zeros(p), scale, x)
            model = irls(scaled, p, penalty, model, rounds, 1e-3, F.col(group).isin(*fit.held), x, y)
        out.append(Linear(model.intercept, model.coef * scale))
    return out


def block_ridge(rows: DataFrame, p: int, block_of: np.ndarray, presets: Sequence[Sequence[float]], penalties: Sequence[float], held: Column, x: str = "x", y: str = "y", rounds: int = 3) -> Linear:
    """A penalty for each block of columns: of the presets (multipliers by block) and the path's penalties, those of least
    nmae on the held-out rows, all of them scored in one pass; then all rows, reweighted towards least absolute errors.
    Columns are standardised beforehand; the intercept is the target's mean."""
    marked = rows.withColumn("_held", F.coalesce(held, F.lit(False)).cast("int"))
    return block_ridges(marked, p, block_of, presets, penalties, [Fit(frozenset([0]), frozenset([1]))], "_held", x, y, rounds)[0]


def clip_range(low: float, high: float) -> tuple[float, float]:
    """Where predictions of a heart rate are clipped to, by the training targets' range."""
    return max(low - 15, 25.0), min(high + 15, 230.0)
