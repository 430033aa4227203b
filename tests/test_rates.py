"""Feature sets of the plain heart-rate models against column expressions, and their tasks against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.functions import arrays as A
from wavespark.functions import shapes as H
from wavespark.operators import linear as L
from wavespark.operators import longform
from wavespark.operators import search as SE
from wavespark.plans import rates

R = np.random.default_rng(31)


@pytest.fixture(scope="module")
def signals(spark):
    t = np.arange(640) / 64
    x = np.sin(2 * np.pi * R.uniform(0.8, 2.5, 12)[:, None] * t) + 0.3 * R.normal(size=(12, 640))
    x[10] = np.arange(640) / 100.0  # neither a peak nor a trough
    x[11, :] = np.r_[np.zeros(320), 1, np.zeros(319)]  # one peak
    return x, spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, w array<double>").repartition(3)


def columns_of(rows, columns):
    found = sorted(rows.select("row_id", F.struct(*[c.alias(k) for k, c in columns.items()]).alias("s")).collect(), key=lambda r: r["row_id"])
    return {k: np.array([r["s"][k] for r in found], float) for k in columns}


def test_kernels_are_the_column_expressions(signals):
    x, rows = signals
    w = F.col("w")
    own = H.stats(x) | H.skewness(x) | H.crossings(x, 64) | H.curvature(x) | H.recency(x, 0.5, 64) | H.growth(H.seconds(x)[2]) | H.contrast(*H.seconds(x)[:2]) | H.period(x, 64)
    d2 = A.diff(A.diff(w))
    ewma = A.ewma(w, 32)
    blocks = A.block_summary(w, 10, 64)
    logs = F.transform(blocks["energy"], lambda e: F.ln(e + 1e-6))
    ends = lambda c: F.element_at(c, -1) - F.get(c, F.lit(0))
    want = A.stats(w) | {
        "skew": A.moment(w, 3, 1e-8), "kurtosis": A.moment(w, 4, 1e-8) - 3, "zcr_count": A.zero_crossings(w), "zcr_bpm": A.zero_crossing_bpm(w, 64.0),
        "d2_mean": A.mean(d2), "d2_std": A.std(d2), "d2_energy": A.energy(d2), "ewma_hl0p5_level": ewma["level"], "ewma_hl0p5_std": ewma["std"],
        "ewma_hl0p5_momentum": ewma["momentum"], "exp_trend_rate": A.slope(logs), "exp_trend_logscale": A.intercept(logs),
        "recency_mean_delta": ends(blocks["mean"]), "recency_std_delta": ends(blocks["std"]),
    }
    found = columns_of(rows, want)
    for k in want:
        assert np.allclose(own[k], found[k], atol=1e-8), k
    found = columns_of(rows.where("row_id < 10"), A.autocorr_bpm(w, 64.0))
    assert np.allclose(own["autocorr_bpm"][:10], found["bpm"]) and np.allclose(own["autocorr_peak"][:10], found["peak"])
    bank = H.periods(x[:10], 64)
    found = columns_of(rows.where("row_id < 10"), {k: A.harmonic_bank(w, 64.0)[k] for k in ("bpm1", "c1", "bpm2", "c2", "ratio", "harmonic_bpm", "harmonic_score")})
    assert np.allclose(list(bank.values())[:7], list(found.values())) and np.allclose(bank["harmonic_bpm_sq"], bank["harmonic_bpm"] ** 2)
    found = rows.orderBy("row_id").select(A.sliding_correlation(w, 64, 8).alias("c")).collect()
    assert np.allclose(np.column_stack(list(H.against_last(x, 64, 8).values())), [r["c"] for r in found], atol=1e-9)


def test_morphology_is_the_long_form(signals):
    x, rows = signals
    found = sorted(longform.peak_morphology(rows, 64.0).collect(), key=lambda r: r["row_id"])
    own = np.column_stack(list(H.morphology(x, 64.0).values()))
    # Where there is no trough at all, the published form gives amplitudes and legs of 0, and so do both.
    assert np.allclose(own, [list(r)[1:] for r in found], atol=1e-9)


def test_motion_and_skin_are_the_column_expressions(spark):
    axes, skin = R.normal(size=(5, 3, 320)), np.abs(R.normal(size=(5, 40)))
    rows = spark.createDataFrame([(k, *a.tolist(), s.tolist()) for k, (a, s) in enumerate(zip(axes, skin, strict=True))], "row_id long, x array<double>, y array<double>, z array<double>, e array<double>")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    jerk = A.jerk(x, y, z, 32)
    want = {**A.axis_interactions(x, y, z), "sma": A.signal_magnitude_area(x, y, z), **{f"jerk_{k}": v for k, v in jerk.items()}}
    found = columns_of(rows, want)
    assert np.allclose(list(H.motion(axes).values()), list(found.values()))
    slow = columns_of(rows, {"s": A.slope(A.trailing_mean(F.col("e"), 4)), "p": A.std(F.zip_with("e", A.trailing_mean(F.col("e"), 4), lambda a, b: a - b))})
    own = H.tonic(skin, 4)
    assert np.allclose(own["tonic_slope"], slow["s"]) and np.allclose(own["phasic_std"], slow["p"])


def test_sets_have_their_published_widths():
    x = (R.normal(size=(3, 640)), R.normal(size=(3, 3, 320)), np.abs(R.normal(size=(3, 40))))
    assert [len(f(*x)) for f in (H.plain, H.correlated, H.shaped, H.harmonic)] == [68, 140, 123, 137]
    assert all(np.isfinite(v).all() for f in (H.plain, H.correlated, H.harmonic) for v in f(*x).values())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Training and test windows whose rate is in the pulse, as CSV."""
    folder, r = tmp_path_factory.mktemp("rates"), np.random.default_rng(2)
    t = np.arange(640) / 64
    out = {}
    for name, n in (("train", 63), ("test", 11)):
        hr = r.uniform(55, 150, n)
        pulse = np.sin(2 * np.pi * hr[:, None] / 60 * t + r.uniform(0, 6, (n, 1))) + 0.1 * r.normal(size=(n, 640))
        axes, skin = 0.2 * r.normal(size=(n, 3, 320)), 1 + 0.1 * r.random((n, 40))
        block = np.concatenate([axes.reshape(n, 3, 10, 32).transpose(0, 2, 1, 3).reshape(n, 10, 96), pulse.reshape(n, 10, 64), skin.reshape(n, 10, 4)], axis=2)
        x = block.reshape(n, 1640)
        with open(folder / f"{name}.csv", "w") as f:
            f.write(",".join([f"c{k}" for k in range(1640)] + (["hr"] if name == "train" else [])) + "\n")
            for row, y in zip(x, hr, strict=True):
                f.write(",".join(repr(float(v)) for v in row) + (f",{float(y)!r}" if name == "train" else "") + "\n")
        out[name] = (pulse, axes, skin, hr)
    return folder, out


def standard(variant, data):
    z = np.column_stack(list(getattr(H, rates.VARIANTS[variant].features)(*data[:3]).values()))
    return z, data[3]


@pytest.mark.parametrize("variant", ["shaped", "harmonic"])
def test_ridge_variants(spark, files, variant):
    folder, data = files
    got, model = rates.rate_task(spark, f"{folder}/train.csv", f"{folder}/test.csv", variant, penalties=(0.1, 10.0, 1000.0))
    z, y = standard(variant, data["train"])
    mean, scale = z.mean(0), z.std(0)
    s = (z - mean) / np.where(scale > 1e-12, scale, 1)
    fold = np.repeat(np.arange(5), [13, 13, 13, 12, 12])

    def fitted(rows, lam):
        m, level = s[rows].mean(0), y[rows].mean()
        w = np.linalg.solve((s[rows] - m).T @ (s[rows] - m) + lam * np.eye(s.shape[1]), (s[rows] - m).T @ (y[rows] - level))
        return lambda t: level + (t - m) @ w

    score = {}
    for lam in (0.1, 10.0, 1000.0):
        score[lam] = np.mean([((y - fitted(fold != f, lam)(s))[fold == f] ** 2).sum() / ((y[fold == f] - y[fold == f].mean()) ** 2).sum() for f in range(5)])
    best = min(score, key=score.get)
    assert model.chosen["penalty"] == best and len(model.names) == z.shape[1]
    u, truth = standard(variant, data["test"])
    p = np.array([r["p"] for r in got.orderBy("row_id").collect()])
    assert np.allclose(p, fitted(fold >= 0, best)((u - mean) / np.where(scale > 1e-12, scale, 1)), atol=1e-5)
    assert np.abs(p - truth).mean() < 12


def test_elastic_net_variant(spark, files):
    folder, data = files
    got, model = rates.rate_task(spark, f"{folder}/train.csv", f"{folder}/test.csv", "plain", alphas=(0.5, 5.0), ratios=(0.5, 1.0))
    z, y = standard("plain", data["train"])
    scale = np.where(z.std(0) > 1e-12, z.std(0), 1)
    s = (z - z.mean(0)) / scale
    w = model.linear.coef * scale
    a, ratio = model.chosen["alpha"], model.chosen["l1_ratio"]
    slope = s.T @ (y - y.mean() - s @ w) / len(y)
    for g, c in zip(slope, w, strict=True):
        assert abs(g) <= a * ratio + 1e-4 if c == 0 else np.isclose(g, a * ratio * np.sign(c) + a * (1 - ratio) * c, atol=1e-4)
    u, truth = standard("plain", data["test"])
    p = np.array([r["p"] for r in got.orderBy("row_id").collect()])
    assert np.allclose(p, y.mean() + (u - z.mean(0)) @ model.linear.coef) and np.abs(p - truth).mean() < 12


def test_gated_variant(spark, files):
    folder, data = files
    got, model = rates.rate_task(spark, f"{folder}/train.csv", f"{folder}/test.csv", "gated", strengths=(0.1, 0.5))
    z, y = standard("gated", data["train"])
    assert len(model.stage.columns) == 73 and model.stage.columns[0] == 67 and model.chosen["strength"] in (0.1, 0.5)
    g = model.stage.values(z)
    scale = np.where(g.std(0) > 1e-12, g.std(0), 1)
    s = (g - g.mean(0)) / scale
    w = np.linalg.solve(s.T @ s + model.chosen["penalty"] * np.eye(s.shape[1]), s.T @ (y - y.mean()))
    u, _ = standard("gated", data["test"])
    p = np.array([r["p"] for r in got.orderBy("row_id").collect()])
    assert np.allclose(p, y.mean() + (model.stage.values(u) - g.mean(0)) / scale @ w, atol=1e-6)
    assert isinstance(model.stage, SE.Gate) and isinstance(model.linear, L.Linear)
