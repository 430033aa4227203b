"""Heart rate from one feature set and one linear model chosen by cross-validation: the variants of task C, end to end."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import shapes
from ..operators import gram as G
from ..operators import linear, search, splits
from ..operators.kernels import apply_kernel, names_of
from ..sources import windows as src
from .tasks import C_WIDTHS, window_columns

FOLDS = 5
#: The grids of the variants.
NET_ALPHAS, NET_RATIOS = tuple(np.logspace(-2, 2, 50).tolist()), (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)
RIDGE_PENALTIES = tuple(np.logspace(-3, 4, 40).tolist())


@dataclass(frozen=True)
class Variant:
    """A feature set; and the model: net (elastic net), gate (a gate on the correlations, then a ridge by leave-one-out) or
    ridge, on standardised columns."""

    features: str
    model: str


VARIANTS = {"plain": Variant("plain", "net"), "gated": Variant("correlated", "gate"), "shaped": Variant("shaped", "ridge"), "harmonic": Variant("harmonic", "ridge")}


def _kernel(variant: Variant):
    features = getattr(shapes, variant.features)
    return lambda a, n: features(a["bvp"], a["motion"].reshape(n, 3, 320), a["eda"])


def features(windows: DataFrame, variant: Variant) -> DataFrame:
    """row_id, y and x of windows as tasks.window_columns gives them, batch by batch."""
    return apply_kernel(windows, _kernel(variant), C_WIDTHS, ["row_id", "y"], packed=True)


def fold_ends(n: int, folds: int = FOLDS) -> list[int]:
    """Exclusive ends of contiguous folds, the first n % folds of which have one row more."""
    return np.cumsum([n // folds + (k < n % folds) for k in range(folds)]).tolist()


@dataclass
class RateModel:
    variant: Variant
    names: list[str]
    linear: linear.Linear
    stage: search.Gate | None
    chosen: dict[str, float]

    def predict(self, windows: DataFrame) -> DataFrame:
        """row_id and p."""
        rows = features(windows, self.variant)
        return linear.predicted(self.stage.apply(rows) if self.stage else rows, self.linear).select("row_id", "p")


def fit(windows: DataFrame, n: int, variant: Variant, alphas=NET_ALPHAS, ratios=NET_RATIOS, penalties=RIDGE_PENALTIES, strengths=search.STRENGTHS) -> RateModel:
    """windows: rows 0..n-1 in their order, with y. One pass over the features sums the folds, from which nets and ridges are
    chosen and fitted (a gate takes two); what comes to the driver has the size of the design's width."""
    names = names_of(_kernel(variant), C_WIDTHS)
    p = len(names)
    rows = splits.contiguous(features(windows, variant), fold_ends(n)).persist()
    try:
        if variant.model == "gate":
            gated = tuple(k for k, c in enumerate(names) if c == "bvp_autocorr_peak" or "_xcorr_" in c)
            found = search.nested_search(rows, p, [search.Gate(gated, s) for s in strengths])
            return RateModel(variant, names, found.model, found.stage, {"strength": found.stage.strength, "penalty": found.penalties[found.best]})
        parts = G.normal_equations(rows, p, fold="fold")
    finally:
        rows.unpersist()
    everything = G.total(parts)
    scale = np.sqrt(np.diag(everything.spread)[:-1] / everything.weight)
    scale = np.where(scale > 0, scale, 1.0)
    parts = {f: part.scaled(1 / scale) for f, part in parts.items()}
    if variant.model == "net":
        alpha, ratio, model = linear.elastic_net_cv(parts, alphas, ratios)
        chosen = {"alpha": alpha, "l1_ratio": ratio}
    else:
        _, best, model = linear.ridge_choice(parts, penalties)
        chosen = {"penalty": penalties[best]}
    return RateModel(variant, names, linear.Linear(model.intercept, model.coef / scale), None, chosen)


def rate_task(spark: SparkSession, train: str, test: str, variant: str, **grids) -> tuple[DataFrame, RateModel]:
    """Predictions (row_id, p) of the test file's windows by a variant fitted on the training file's, and the model."""
    rows = src.require_target(src.read_table(spark, train))
    model = fit(window_columns(rows), rows.count(), VARIANTS[variant], **grids)
    return model.predict(window_columns(src.read_table(spark, test))), model
