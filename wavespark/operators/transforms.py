"""Column transforms whose parameters are fitted on training rows: one pass of aggregates, then narrow expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gram import Normal
from .quantiles import exact_quantiles


def _ok(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _value(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(_ok(c), c)


@dataclass
class Standard:
    names: list[str]
    mean: list[float]
    scale: list[float]

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({c: (F.col(f"`{c}`") - m) / s for c, m, s in zip(self.names, self.mean, self.scale, strict=True)})


def fit_standard(rows: DataFrame, names: Sequence[str], epsilon: float = 0.0) -> Standard:
    """Population mean and deviation. With epsilon 0 a constant column has scale 1, else epsilon is added."""
    found = rows.agg(*[F.avg(_value(c)) for c in names], *[F.stddev_pop(_value(c)) for c in names]).first()
    p = len(names)
    scale = [s + epsilon if epsilon else (s or 1.0) for s in found[p:]]
    return Standard(list(names), list(found[:p]), scale)


@dataclass
class Robust:
    """Imputes the median, clips to percentiles, drops what is constant then, and standardises."""

    names_in: list[str]
    median: list[float]
    low: list[float]
    high: list[float]
    keep: list[bool]
    mean: list[float]
    scale: list[float]

    @property
    def names_out(self) -> list[str]:
        return [c for c, k in zip(self.names_in, self.keep, strict=True) if k]

    def clipped(self, rows: DataFrame) -> DataFrame:
        """Imputed and clipped, not standardised: what coefficients in the columns' own units are for."""
        out = {c: F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce(_value(c), F.lit(m)))) for c, m, lo, hi in zip(self.names_in, self.median, self.low, self.high, strict=True)}
        return rows.withColumns(out).drop(*[c for c, k in zip(self.names_in, self.keep, strict=True) if not k])

    def apply(self, rows: DataFrame) -> DataFrame:
        own = dict(zip(self.names_in, zip(self.mean, self.scale, strict=True), strict=True))
        return self.clipped(rows).withColumns({c: (F.col(f"`{c}`") - own[c][0]) / own[c][1] for c in self.names_out})

    def state(self) -> dict:
        return asdict(self)


def fit_robust(rows: DataFrame, names: Sequence[str], tails: tuple[float, float] = (0.005, 0.995)) -> Robust:
    """Medians of the values there are, then percentiles, mean and deviation of the imputed ones. Exact, by
    quantiles.exact_quantiles: a few passes, so persist rows that are costly to make."""
    median = {c: v[0] if v[0] == v[0] else 0.0 for c, v in exact_quantiles(rows, {c: _value(c) for c in names}, [0.5]).items()}
    imputed = {c: F.coalesce(_value(c), F.lit(median[c])) for c in names}
    ends = exact_quantiles(rows, imputed, tails)
    low, high = ([ends[c][k] if ends[c][k] == ends[c][k] else 0.0 for c in names] for k in range(2))
    high = [h if h > lo else lo + 1 for lo, h in zip(low, high, strict=True)]
    p = len(names)
    all_kept = Robust(list(names), [median[c] for c in names], low, high, [True] * p, [0.0] * p, [1.0] * p)
    second = all_kept.clipped(rows).agg(*[F.avg(f"`{c}`") for c in names], *[F.stddev_pop(f"`{c}`") for c in names]).first()
    mean, deviation = [m or 0.0 for m in second[:p]], list(second[p:])
    return Robust(list(names), all_kept.median, low, high, [(s or 0) > 1e-9 for s in deviation], mean, [(s or 0) + 1e-9 for s in deviation])


def yeo_johnson(c: Column, lam: float) -> Column:
    up = F.log1p(c) if abs(lam) < 1e-12 else (F.pow(c + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-c) if abs(lam - 2) < 1e-12 else -(F.pow(1 - c, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(c >= 0, up).otherwise(down)


def _powers(v: np.ndarray, lam: float) -> np.ndarray:
    up, down = np.maximum(v, 0), np.minimum(v, 0)
    up = np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam
    down = -np.log1p(-down) if abs(lam - 2) < 1e-12 else -(np.power(1 - down, 2 - lam) - 1) / (2 - lam)
    return np.where(v >= 0, up, down)


def _spreads(batches: Iterator[pa.RecordBatch], grids: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """For each batch, column and grid point: count, mean and squared distances of the transformed values, and the sum of
    signed logs."""
    for batch in batches:
        out = []
        for k, (c, grid) in enumerate(grids.items()):
            v = batch.column(k).to_numpy(zero_copy_only=False).astype(float)
            v = v[np.isfinite(v)]
            if not len(v):
                continue
            logs = float((np.sign(v) * np.log1p(np.abs(v))).sum())
            for j, lam in enumerate(grid):
                t = _powers(v, float(lam))
                out.append((c, j, len(v), float(t.mean()), float(((t - t.mean()) ** 2).sum()), logs))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["c", "j", "n", "mean", "square", "logs"])


def _combined(group: pa.Table) -> pa.Table:
    """Batches' counts, means and squared distances as one: about the common mean, so that nothing large is subtracted."""
    n, mean = group["n"].to_numpy(), group["mean"].to_numpy()
    apart = mean - n @ mean / n.sum()
    square = float(group["square"].to_numpy().sum() + n @ (apart * apart))
    return pa.table({"c": group["c"][:1], "j": group["j"][:1], "n": [int(n.sum())], "square": [square], "logs": [float(group["logs"].to_numpy().sum())]})


def power_likelihoods(rows: DataFrame, grids: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The mean log likelihood of each Yeo-Johnson parameter of each column's grid, all from one pass over the rows; -inf
    where the transformed column is constant."""
    slim = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in grids])
    parts = slim.mapInArrow(lambda batches: _spreads(batches, grids), "c string, j long, n long, mean double, square double, logs double")
    found = parts.groupBy("c", "j").applyInArrow(_combined, "c string, j long, n long, square double, logs double").collect()
    out = {c: np.full(len(grid), -np.inf) for c, grid in grids.items()}
    for r in found:
        if r["square"] > 0:
            out[r["c"]][r["j"]] = -np.log(r["square"] / r["n"]) / 2 + (grids[r["c"]][r["j"]] - 1) * r["logs"] / r["n"]
    return out


def _bends(u: np.ndarray, lam: float) -> np.ndarray:
    """(exp(lam u) - 1) / lam of u = ln(1 + v) >= 0, and its first two derivatives by lam: columns."""
    small = np.abs(lam * u) < 0.5
    out = np.empty((len(u), 3))
    s = u[small]
    if len(s):
        # The power series; its k-th term is u (lam u)^k / (k + 1)!.
        value, first, second = np.zeros((3, len(s)))
        factor = s.copy()  # u^(k + 1) / (k + 1)!
        for k in range(18):
            value += factor * lam**k
            first += factor * (k * lam ** (k - 1) if k > 0 else 0.0)
            second += factor * (k * (k - 1) * lam ** (k - 2) if k > 1 else 0.0)
            factor = factor * s / (k + 2)
        out[small] = np.column_stack([value, first, second])
    b = u[~small]
    if len(b):
        grown = np.exp(lam * b)
        value = (grown - 1) / lam
        first = (b * grown - value) / lam
        out[~small] = np.column_stack([value, first, (b * b * grown - 2 * first) / lam])
    return out


def _derivatives(v: np.ndarray, lam: float) -> np.ndarray:
    """Yeo-Johnson values of v and their first two derivatives by the parameter: columns."""
    out = np.empty((len(v), 3))
    up = v >= 0
    out[up] = _bends(np.log1p(v[up]), lam)
    out[~up] = _bends(np.log1p(-v[~up]), 2 - lam) * np.array([-1.0, 1.0, -1.0])
    return out


def _curves(batches: Iterator[pa.RecordBatch], at: dict[str, float]) -> Iterator[pa.RecordBatch]:
    """Of all rows of a task, a row a column: weight, means and spread of the values and their derivatives, and the sum of
    signed logs."""
    sums: dict[str, Normal] = {}
    logs = dict.fromkeys(at, 0.0)
    for batch in batches:
        for k, (c, lam) in enumerate(at.items()):
            v = batch.column(k).to_numpy(zero_copy_only=False).astype(float)
            v = v[np.isfinite(v)]
            if len(v):
                part = Normal.of(_derivatives(v, lam), np.ones(len(v)))
                sums[c] = sums[c] + part if c in sums else part
                logs[c] += float((np.sign(v) * np.log1p(np.abs(v))).sum())
    out = [(c, n.weight, n.mean.tolist(), n.spread.ravel().tolist(), logs[c]) for c, n in sums.items()]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["c", "n", "mean", "spread", "logs"])


def _added(group: pa.Table) -> pa.Table:
    out = None
    for r in group.to_pylist():
        part = Normal(r["n"], np.array(r["mean"]), np.array(r["spread"]).reshape(3, 3))
        out = part if out is None else out + part
    return pa.table({"c": group["c"][:1], "n": [out.weight], "mean": [out.mean.tolist()], "spread": [out.spread.ravel().tolist()], "logs": [sum(group["logs"].to_pylist())]})


def power_slopes(rows: DataFrame, at: dict[str, float]) -> dict[str, tuple[float, float]]:
    """The first and second derivative of each column's mean log likelihood at a Yeo-Johnson parameter, from one pass. The
    variances and covariances in them are combined from tasks' own, about their means. (0, 0) where a column is constant."""
    slim = rows.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in at])
    cores = rows.sparkSession.sparkContext.defaultParallelism
    schema = "c string, n double, mean array<double>, spread array<double>, logs double"
    parts = slim.coalesce(cores).mapInArrow(lambda batches: _curves(batches, at), schema)
    out = dict.fromkeys(at, (0.0, 0.0))
    for r in parts.groupBy("c").applyInArrow(_added, schema).collect():
        n, s = r["n"], np.array(r["spread"]).reshape(3, 3)
        var = s[0, 0] / n
        if var > 1e-300 and var > 1e-24 * r["mean"][0] ** 2:
            slope, bend = 2 * s[0, 1] / n, 2 * (s[1, 1] + s[0, 2]) / n
            out[r["c"]] = float(-slope / var / 2 + r["logs"] / n), float(-(bend / var - (slope / var) ** 2) / 2)
    return out


def fit_yeo_johnson(rows: DataFrame, names: Sequence[str], rounds: int = 60, tol: float = 1e-10) -> dict[str, float]:
    """The parameter of most likelihood for each column, wherever it is: Newton steps for all columns at once, one pass a
    round, until every derivative is below tol. A step that leaves what is known of a maximum's place is halved into it. A
    constant column keeps 1. Persist rows that are costly to make."""
    lam = dict.fromkeys(names, 1.0)
    low, high, open_ = dict.fromkeys(names, -np.inf), dict.fromkeys(names, np.inf), dict(lam)
    for _ in range(rounds):
        for c, (slope, bend) in power_slopes(rows, open_).items():
            if abs(slope) < tol:
                del open_[c]
                continue
            (low if slope > 0 else high)[c] = lam[c]
            step = -slope / bend if bend < 0 else np.sign(slope) * np.inf
            reach = 2 + abs(lam[c])
            new = lam[c] + float(np.clip(step, -reach, reach))
            if not low[c] < new < high[c]:
                new = (low[c] + high[c]) / 2
            if new in (low[c], high[c]) or new == lam[c]:
                del open_[c]  # no number lies between
                continue
            lam[c] = open_[c] = float(new)
        if not open_:
            break
    return lam


def power_transform(rows: DataFrame, names: Sequence[str]) -> tuple[DataFrame, dict[str, float], Standard]:
    """Yeo-Johnson with the parameter of most likelihood, then mean 0 and deviation 1, for each column; with what was fitted."""
    found = fit_yeo_johnson(rows, names)
    bent = rows.withColumns({c: yeo_johnson(_value(c), found[c]) for c in names})
    scale = fit_standard(bent, names)
    return scale.apply(bent), found, scale


def centre_by(rows: DataFrame, subject: str, names: Sequence[str]) -> DataFrame:
    """Less the subject's own mean. The means are joined, not windowed, so a subject may have any number of rows."""
    means = rows.groupBy(subject).agg(*[F.avg(f"`{c}`").alias(f"_m_{c}") for c in names])
    joined = rows.join(means, subject)
    return joined.withColumns({c: F.col(f"`{c}`") - F.col(f"`_m_{c}`") for c in names}).drop(*[f"_m_{c}" for c in names])


def fit_knots(rows: DataFrame, names: Sequence[str], low: float = 2, high: float = 98, count: int = 9) -> dict[str, list[float]]:
    """Percentiles of each column, evenly spaced from low to high; exact, see quantiles.exact_quantiles."""
    return exact_quantiles(rows, {c: _value(c) for c in names}, [float(q) / 100 for q in np.linspace(low, high, count)])


def expand_bumps(rows: DataFrame, column: str, knots: Sequence[float], name: str) -> DataFrame:
    """Adds name0, name1, ...: the normalised Gaussian bumps of a column around sorted knots, as arrays.bumps has them. The
    knots are known, so the bumps are plain columns that generated code runs."""
    width = max((knots[-1] - knots[0]) / max(len(knots) - 1, 1), 1e-9)
    v = F.col(f"`{column}`").cast("double")
    raw = [f"{name}{k}" for k in range(len(knots))]
    rows = rows.withColumns({c: F.exp(-0.5 * ((v - float(k)) / width) * ((v - float(k)) / width)) for c, k in zip(raw, knots, strict=True)})
    rows = rows.withColumn(f"{name}_sum", sum((F.col(c) for c in raw[1:]), F.col(raw[0])) + 1e-9)
    return rows.withColumns({c: F.col(c) / F.col(f"{name}_sum") for c in raw}).drop(f"{name}_sum")


def target_correlations(rows: DataFrame, names: Sequence[str], target: str) -> list[tuple[str, float]]:
    """|correlation| of each column with the target, the largest first; equal ones in the columns' order."""
    found = rows.agg(*[F.corr(f"`{c}`", target) for c in names]).first()
    size = {c: abs(v) if v is not None and v == v else 0.0 for c, v in zip(names, found, strict=True)}
    return sorted(size.items(), key=lambda x: -x[1])


def top_by_correlation(rows: DataFrame, names: Sequence[str], target: str, k: int) -> list[str]:
    """The k columns of largest |correlation|, in their original order."""
    chosen = {c for c, _ in target_correlations(rows, names, target)[:k]}
    return [c for c in names if c in chosen]


