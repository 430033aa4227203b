"""The four tasks, end to end. Features stay distributed; models are solved from normal equations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import physio, surfaces
from ..operators import gram as G
from ..operators import joins, linear, metrics, splits, transforms
from ..operators.kernels import apply_kernel, names_of
from ..operators.quantiles import exact_quantiles, median
from ..sources import windows as src
from ..sources.subjects import WIDTHS, finite_targets, read_archives


def task_a(spark: SparkSession, train: str, test: str, width: int | None = src.WIDTH) -> tuple[DataFrame, linear.Linear]:
    """Least squares of all columns: predictions (row_id, p) of the test file, and the model."""
    rows = src.require_target(src.read_table(spark, train, width=width))
    p = len(rows.first()["x"])
    model = linear.ols(G.normal_equations(rows, p)[0])
    return linear.predicted(src.read_table(spark, test, width=width), model).select("row_id", "p"), model


def task_b(spark: SparkSession, train: str, test: str, folds: str, lambdas: str, width: int | None = src.WIDTH) -> tuple[DataFrame, linear.Linear, list[float], list[float], int]:
    """Ridge with the given folds and penalties: predictions, model, penalties, their errors, index of the best."""
    rows = src.require_target(src.read_table(spark, train, width=width))
    p, n = len(rows.first()["x"]), rows.count()
    ends, penalties = src.read_folds(spark, folds, n), src.read_lambdas(spark, lambdas)
    errors, best, model = linear.ridge_cv(splits.contiguous(rows, ends), p, penalties)
    return linear.predicted(src.read_table(spark, test, width=width), model).select("row_id", "p"), model, penalties, errors, best


def check_predictions(test: DataFrame, predictions: DataFrame, model: linear.Linear, rtol: float = 1e-5, atol: float = 1e-6) -> DataFrame:
    """One row: n pairs by row_id and bad, those that the weights don't give."""
    own = linear.predicted(test, model, name="own").select("row_id", "own")
    off = F.abs(F.col("p") - F.col("own")) > atol + rtol * F.abs("own")
    return own.join(predictions, "row_id").agg(F.count("*").alias("n"), F.count_if(off).alias("bad"))


def check_penalties(candidates: list[float], reported: list[tuple[float, float]], best: float, rtol: float = 1e-5, atol: float = 1e-6) -> dict[str, bool]:
    """ordered: are the reported (penalty, error) rows the candidates in their order? listed: is the best one a candidate?
    least: is it the one of least reported error, the first of equals?"""
    penalties = np.array([p for p, _ in reported])
    ordered = len(reported) == len(candidates) and bool(np.allclose(penalties, candidates, rtol=rtol, atol=atol))
    first = penalties[int(np.argmin([e for _, e in reported]))] if reported else np.nan
    return {
        "ordered": ordered, "listed": bool(np.any(np.isclose(best, candidates, rtol=rtol, atol=atol))),
        "least": ordered and bool(np.isclose(best, first, rtol=rtol, atol=atol)),
    }


# ------------------------------------------------------------------ task C

C_WIDTHS = {"bvp": 640, "motion": 960, "eda": 40}


def window_columns(rows: DataFrame) -> DataFrame:
    """row_id, y and the arrays that the kernel takes, of rows as read_table gives them."""
    c = src.split_channels(F.col("x"))
    return rows.select("row_id", "y", c["bvp"].alias("bvp"), F.concat(c["acc_x"], c["acc_y"], c["acc_z"]).alias("motion"), c["eda"].alias("eda"))


def scalar_kernel(log_prior: np.ndarray):
    return lambda a, n: surfaces.scalars(a["bvp"], a["motion"].reshape(n, 3, 320), a["eda"], log_prior)


def fit_prior(train: DataFrame, y: str = "y") -> np.ndarray:
    counts = np.zeros(len(surfaces.BPM))
    for r in metrics.histogram(train, y, float(surfaces.BPM[0]), 0.5, len(counts)).collect():
        counts[r["k"]] = r["n"]
    return surfaces.log_prior(counts)


@dataclass
class Knots:
    """Knots of the scalars' bumps (scalars, knots) and, for the full design, of the gates alone and in pairs."""

    scalars: np.ndarray
    gates: dict[str, np.ndarray] | None = None
    pairs: dict[str, np.ndarray] | None = None

    @property
    def full(self) -> bool:
        return self.gates is not None


@dataclass
class HeartRateModel:
    names: list[tuple[str, int]]  # of the design's columns, with their blocks
    prior: np.ndarray
    knots: Knots
    linear: linear.Linear
    low: float
    high: float
    level: float  # the training targets' mean

    def design(self, windows: DataFrame) -> DataFrame:
        return design_c(windows, self.prior, self.knots)

    def predict(self, windows: DataFrame) -> DataFrame:
        """row_id and p, clipped to what the training targets allow; what is no number becomes their mean."""
        return linear.predicted(self.design(windows).select("row_id", "x"), self.linear).select("row_id", clipped("p", self.low, self.high, self.level).alias("p"))


def clipped(p: str, low: float, high: float, level: float) -> Column:
    return F.when(F.isnan(p) | F.col(p).isNull(), F.lit(level)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col(p))))


def design_c(windows: DataFrame, prior: np.ndarray, knots: Knots) -> DataFrame:
    """row_id, y and x: the scalars of each window and their bumps around the knots; with the knots of the full design also
    the tensors and distributions."""

    def expanded(a: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
        pulse, motion = a["bvp"], a["motion"].reshape(n, 3, 320)
        found = surfaces.scored_surfaces(pulse, motion, prior)
        plain = surfaces.scalars(pulse, motion, a["eda"], prior, found)
        blocks = [np.column_stack(list(plain.values())), *(surfaces.bump_basis(v, k) for v, k in zip(plain.values(), knots.scalars, strict=True))]
        if knots.full:
            blocks += [surfaces.tensors(plain, knots.gates, knots.pairs), *surfaces.distributions(found).values()]
        whole = np.concatenate(blocks, axis=1)
        names = surfaces.design_names(list(plain), knots.scalars.shape[1], knots.full)
        if len(names) != whole.shape[1]:
            raise ValueError(f"{len(names)} names for {whole.shape[1]} columns of the design")
        return {c: whole[:, j] for j, (c, _) in enumerate(names)}

    return apply_kernel(windows, expanded, C_WIDTHS, ["row_id", "y"], packed=True)


def fit_knots_c(scalars: DataFrame, names: list[str], full: bool = False) -> Knots:
    found = transforms.fit_knots(scalars, names)
    knots = Knots(np.array([found[c] for c in names]))
    if full:
        at = lambda gates, where: {k: np.array(v) for k, v in zip(gates, transforms.fit_knots(scalars, [surfaces.GATES[g] for g in gates], *where).values(), strict=True)}
        knots.gates = at(list(surfaces.GATES), surfaces.GATE_AT)
        knots.pairs = at(sorted({g for pair in surfaces.GATE_PAIRS for g in pair}), surfaces.PAIR_AT)
    return knots


#: Multipliers of the penalty by block, of the design of two blocks and of the full one.
PRESETS = ((0.1, 1.0), (1.0, 1.0), (0.03, 0.3), (0.01, 30.0))
FULL_PRESETS = ((0.1, 1.0, 10.0, 10.0), (1.0, 1.0, 1.0, 1.0), (0.03, 0.3, 3.0, 30.0), (0.01, 30.0, 100.0, 100.0))


def standard_design(rows: DataFrame, p: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """row_id, y and x, less its mean and over its deviation plus 1e-8; with both."""
    everything = G.normal_equations(rows, p)[0]
    gram, _, mean, _ = linear.centred(everything)
    scale = np.sqrt(np.maximum(np.diag(gram), 0) / everything.weight) + 1e-8
    return linear.moved(rows.select("row_id", "y", "x"), mean, 1 / scale), mean, scale


def fit_heart_rate(windows: DataFrame, n: int, penalties=linear.LAMBDAS_C, presets=PRESETS, full: bool = False) -> HeartRateModel:
    """windows: row_id (0..n-1 in order), y and the arrays of window_columns. Four barriers, each an aggregate over the
    rows: the prior, the knots, the columns' scale and the normal equations. The last quarter of rows is held out. full
    adds the tensors and distributions, 5,032 columns instead of 1,960; pass FULL_PRESETS with it."""
    prior = fit_prior(windows)
    kernel = scalar_kernel(prior)
    scalar_names = names_of(kernel, C_WIDTHS)
    scalars = apply_kernel(windows, kernel, C_WIDTHS, ["row_id", "y"]).persist()
    knots = fit_knots_c(scalars, scalar_names, full)
    scalars.unpersist()
    names = surfaces.design_names(scalar_names, knots.scalars.shape[1], full)
    block_of = np.array([b for _, b in names])
    rows = design_c(windows, prior, knots).persist()
    standard, mean, scale = standard_design(rows, len(names))
    model = linear.block_ridge(standard, len(names), block_of, presets, penalties, F.col("row_id") >= int(n * 0.75))
    coef = model.coef / scale
    ends = rows.agg(F.min("y").alias("a"), F.max("y").alias("b"), F.avg("y").alias("m")).first()
    rows.unpersist()
    low, high = linear.clip_range(ends["a"], ends["b"])
    return HeartRateModel(names, prior, knots, linear.Linear(model.intercept - float(coef @ mean), coef), low, high, ends["m"])


# ------------------------------------------------------------------ task D


def subject_kernel(a: dict[str, np.ndarray], n: int) -> dict[str, np.ndarray]:
    """Channels without a single sample in a batch still give their columns, from rows of missing samples."""
    return physio.features({c: v.reshape(n, -1, 3) if c.endswith("acc") else v for c, v in a.items()}, n)


def subject_features(rows: DataFrame, channels: list[str] | None = None, batch: int = 16) -> DataFrame:
    """subject_id, ts, glucose and a column for each of the 343 features, or fewer if only some channels are named."""
    widths = {c: w for c, w in WIDTHS.items() if channels is None or c in channels}
    return apply_kernel(rows, subject_kernel, widths, ["subject_id", "ts", "glucose"], rows=batch)


def with_protocol(rows: DataFrame, protocol: str, folds: int = 5) -> DataFrame:
    """Adds what the protocol's splits need: d1 fold, of a shuffle of the row numbers if rows have them (row_id), else by hash; d2 part, beyond how many of the cuts at half and three quarters of its subject's time a row is; d3 fold, one
    for each of up to eight subjects, that is left out."""
    if protocol == "d1" and "row_id" in rows.columns:
        # Rows that were dropped leave gaps, so the numbers are taken anew, in their order.
        placed = joins.place_in_order(rows.withColumn("_all", F.lit(0)), "_all", "row_id", "row_id")
        rows = placed.withColumn("row_id", F.col("_place") - 1).drop("_all", "_place", "_count")
        return splits.shuffled(rows, rows.count(), folds)
    if protocol == "d1":
        return splits.hashed(rows.withColumn("row_id", F.xxhash64("subject_id", "ts")), folds)
    if protocol == "d2":
        return splits.temporal_parts(rows.withColumn("_tie", F.xxhash64("subject_id", "ts")), "subject_id", "ts", [0.5, 0.75], "_tie").drop("_tie")
    return splits.leave_one_out(rows, "subject_id")


def protocol_splits(rows: DataFrame, protocol: str) -> list[tuple[Column, Column]]:
    """Training and test conditions over rows of with_protocol: d2 has two, the latest quarter of each subject and, before
    it, the quarter before that. Splits without a row on either side are left out; if none is left, the last quarter of the
    rows by their numbers (row_id) is for testing, or, of rows without numbers, a quarter by a hash."""
    if protocol == "d2":
        part = F.col("part")
        found = [(part < 2, part == 2), (part < 1, part == 1)]
    else:
        fold = F.coalesce("fold", F.lit(-1))
        known = rows.select("fold").where("fold IS NOT NULL").distinct().orderBy("fold").collect()
        found = [(fold != r[0], fold == r[0]) for r in known]
    sizes = rows.agg(*[F.count_if(c) for pair in found for c in pair]).first() if found else []
    found = [pair for k, pair in enumerate(found) if sizes[2 * k] and sizes[2 * k + 1]]
    if found:
        return found
    test = F.pmod(F.xxhash64("subject_id", "ts", F.lit(3)), F.lit(4)) == 0
    if "row_id" in rows.columns and (n := rows.count()) > 1:
        at = int(n * 0.75) / (n - 1)
        test = F.col("row_id") > exact_quantiles(rows, {"row_id": F.col("row_id")}, [at])["row_id"][0] - 0.5
    return [(~test, test)]


def evaluate_penalties(rows: DataFrame, protocol: str, p: int, penalties, x: str = "x", fitted_on: str = "x") -> list[float]:
    """Mean nmae over the protocol's splits of each penalty. Models are fitted on the column fitted_on of the training rows
    and scored on x of the test rows."""
    found = []
    for train, test in protocol_splits(rows, protocol):
        models = linear.ridge_path(G.normal_equations(rows.where(train), p, fitted_on)[0], penalties, centre=False)
        found.append([nmae for nmae, _ in linear.scored(rows.where(test), models, x)])
    return np.mean(found, axis=0).tolist()


def fit_glucose(features: DataFrame, protocol: str, penalties=linear.LAMBDAS_D, most: int = 480) -> dict:
    """Drops rows without a finite target (an error if under 20 are left), imputes, clips and standardises, chooses columns by
    correlation and the penalty by cross-validation, refits on all rows, reweighted towards least absolute errors. For d3
    the training rows of a split may also be centred by subject, if that scores better; the rows tested are never. The
    model's intercept takes the centring back, so that it is for columns as they are.
    Returns the model's state, as write_model takes it."""
    keys = ["subject_id", "ts", "glucose", *(c for c in ("row_id",) if c in features.columns)]
    names = [c for c in features.columns if c not in keys]
    features = finite_targets(features).persist()
    fitted = transforms.fit_robust(features, names)
    clean = fitted.apply(features)
    if not fitted.names_out:
        raise ValueError("all features are constant")
    chosen = transforms.top_by_correlation(clean, fitted.names_out, "glucose", most)
    rows = with_protocol(clean, protocol)
    packed = lambda table, name: table.withColumn(name, F.array(*[F.col(f"`{c}`") for c in chosen]))
    own = packed(rows, "x")
    if protocol == "d3":
        own = packed(transforms.centre_by(own, "subject_id", chosen), "centred")
    table = own.select("subject_id", "ts", F.col("glucose").alias("y"), *[c for c in ("x", "centred", "fold", "part") if c in own.columns]).persist()
    tried = []
    for column in ("x", "centred") if protocol == "d3" else ("x",):
        errors = evaluate_penalties(table, protocol, len(chosen), penalties, fitted_on=column)
        k = int(np.argmin(errors))
        tried.append((errors[k], float(penalties[k]), column))
    score, penalty, column = min(tried, key=lambda t: t[0])
    normal = G.normal_equations(table, len(chosen), column)[0]
    gram, moment, level = linear.about_mean(normal)
    start = linear.Linear(level, np.linalg.solve(gram + penalty * np.eye(len(chosen)), moment))
    model = linear.irls(table, len(chosen), penalty, start, rounds=4, floor_add=1e-6, x=column, weighted_level=True)
    mean_of = lambda c: G.normal_equations(table, len(chosen), c)[0].gram[0, 1:] / normal.weight
    offset = mean_of("x") - mean_of("centred") if column == "centred" else np.zeros(len(chosen))
    table.unpersist()
    features.unpersist()
    scale = dict(zip(fitted.names_in, zip(fitted.mean, fitted.scale, strict=True), strict=True))
    coef = np.array([c / scale[n][1] for c, n in zip(model.coef, chosen, strict=True)])
    intercept = model.intercept - float(offset @ model.coef) - float(sum(c * scale[n][0] for c, n in zip(coef, chosen, strict=True)))
    return {
        "format_version": 1, "protocol": protocol, "intercept": intercept, "coef": coef.tolist(), "feature_names": chosen,
        "preprocessing": fitted.state(), "cv_nmae": score, "penalty": penalty, "centred": column == "centred",
    }


def apply_glucose(features: DataFrame, state: dict) -> DataFrame:
    """Adds p. Columns are found by name, missing ones imputed; values are clipped but not standardised, as the
    coefficients are in the columns' own units."""
    fitted = transforms.Robust(**state["preprocessing"])
    keys = features.select("subject_id", "ts", "glucose", *[c for c in features.columns if c in set(fitted.names_in)])
    aligned = keys.select("subject_id", "ts", "glucose", *[F.col(f"`{c}`") if c in keys.columns else F.lit(float("nan")).alias(c) for c in fitted.names_in])
    clean = fitted.clipped(aligned)
    x = F.array(*[F.col(f"`{c}`") for c in state["feature_names"]])
    return clean.withColumn("p", A.dot(x, A.constant(state["coef"])) + float(state["intercept"]))


def load_features(tables: list[DataFrame]) -> DataFrame:
    """Feature tables of several sources, as one, with the columns that all of them have."""
    return joins.union_common(tables)


def load_feature_folder(spark: SparkSession, folder: str, keys: tuple[str, ...] = ("subject_id", "ts", "glucose")) -> DataFrame:
    """Feature tables of any number of subjects, one Parquet file or more each in a folder, as one scan, with the columns that
    have values in every file."""
    rows = spark.read.option("mergeSchema", "true").parquet(folder)
    names = [c for c, kind in rows.dtypes if c not in keys and kind in ("double", "float", "int", "bigint")]
    return joins.union_of_sources(rows, F.col("_metadata.file_path"), [c for c in keys if c in rows.columns], names)


def nearest_to_median(rows: DataFrame, target: str, order: str) -> DataFrame:
    """The row whose target is nearest the rows' median, with distance; of equals the first in order. Empty for no rows."""
    middle = median(rows, F.col(target))
    return rows.withColumn("distance", F.abs(F.col(target) - F.lit(middle))).orderBy("distance", order).limit(1)


def representative_subject_window(spark: SparkSession, folder: str) -> DataFrame:
    """Of the smallest archive in a folder (by bytes, then path), the window with a finite target and no gap in its heart rate
    whose target is nearest their median, and squared, its acceleration's square over the mean: what a figure shows.
    Only the names and sizes of the other archives are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "length")
    path = files.orderBy("length", "path").first()["path"]
    rows = read_archives(spark, path)
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    fine = rows.where(finite(F.col("glucose")) & F.col("e4_hr").isNotNull() & F.forall("e4_hr", lambda v: finite(v)))
    found = nearest_to_median(fine, "glucose", "ts")
    axes = F.transform(F.sequence(F.lit(0), (F.size("e4_acc") / 3).cast("int") - 1), lambda k: F.slice("e4_acc", 3 * k + 1, F.lit(3)))
    squares = F.transform(axes, lambda a: A.energy(a.cast("array<double>")))
    squared = A.let(squares, lambda s: A.let(A.mean(A.finite(s)), lambda m: F.transform(s, lambda v: v / m)))
    return found.withColumn("squared", F.when(F.col("e4_acc").isNotNull(), squared)).withColumn("path", F.lit(path))
