"""Statistics, pulse shapes, recency and periods of ten-second windows, whole batches at once: the feature sets of the plain
heart-rate models. Each function takes rows of samples and returns columns by name."""

from __future__ import annotations

from functools import cache

import numpy as np

Columns = dict[str, np.ndarray]

PULSE_HZ, MOTION_HZ, SKIN_HZ, SECONDS = 64.0, 32.0, 4.0, 10
LOW_BPM, HIGH_BPM = 40.0, 200.0


def slopes(rows: np.ndarray) -> np.ndarray:
    t = np.arange(rows.shape[1]) - (rows.shape[1] - 1) / 2
    return rows @ t / (t @ t)


def stats(x: np.ndarray) -> Columns:
    d = np.diff(x, axis=1)
    q25, median, q75 = np.quantile(x, (0.25, 0.5, 0.75), axis=1)
    return {
        "mean": x.mean(axis=1), "std": x.std(axis=1), "min": x.min(axis=1), "max": x.max(axis=1), "median": median, "q25": q25, "q75": q75,
        "energy": (x * x).sum(axis=1), "diff_mean": d.mean(axis=1), "diff_std": d.std(axis=1), "slope": slopes(x),
    }


def skewness(x: np.ndarray) -> Columns:
    z = (x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + 1e-8)
    return {"skew": (z**3).mean(axis=1), "kurtosis": (z**4).mean(axis=1) - 3}


def crossings(x: np.ndarray, rate: float) -> Columns:
    above = x >= x.mean(axis=1, keepdims=True)
    count = (above[:, 1:] != above[:, :-1]).sum(axis=1).astype(float)
    return {"zcr_count": count, "zcr_bpm": 30 * count * rate / (x.shape[1] - 1)}


def curvature(x: np.ndarray) -> Columns:
    d = np.diff(x, n=2, axis=1)
    return {"d2_mean": d.mean(axis=1), "d2_std": d.std(axis=1), "d2_energy": (d * d).sum(axis=1)}


def _where(values: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the chosen values of each row; 0 where there are none."""
    n = np.maximum(chosen.sum(axis=1), 1)
    mean = np.where(chosen, values, 0).sum(axis=1) / n
    return mean, np.sqrt(np.where(chosen, (values - mean[:, None]) ** 2, 0).sum(axis=1) / n)


def morphology(x: np.ndarray, rate: float) -> Columns:
    """Peaks and troughs (above or below both neighbours): how many; height over the trough before (else the one after), time
    up and down, and between peaks, means and deviations."""
    at = np.arange(x.shape[1])
    inner = np.pad((x[:, 1:-1] > x[:, :-2]) & (x[:, 1:-1] > x[:, 2:]), ((0, 0), (1, 1)))
    low = np.pad((x[:, 1:-1] < x[:, :-2]) & (x[:, 1:-1] < x[:, 2:]), ((0, 0), (1, 1)))
    before = np.maximum.accumulate(np.where(low, at, -1), axis=1)
    after = np.minimum.accumulate(np.where(low, at, len(at))[:, ::-1], axis=1)[:, ::-1]
    last = np.pad(np.maximum.accumulate(np.where(inner, at, -1), axis=1)[:, :-1], ((0, 0), (1, 0)), constant_values=-1)
    base = np.where(before >= 0, before, np.minimum(after, len(at) - 1))
    found = {"amp": (x - np.take_along_axis(x, base, 1), inner & ((before >= 0) | (after < len(at)))), "rise": ((at - before) / rate, inner & (before >= 0))}
    found |= {"fall": ((after - at) / rate, inner & (after < len(at))), "iv": ((at - last) / rate, inner & (last >= 0))}
    mean, std = ({k: _where(*v)[j] for k, v in found.items()} for j in range(2))
    out = {"peak_count": inner.sum(axis=1).astype(float), "trough_count": low.sum(axis=1).astype(float)}
    for k in ("amp", "rise", "fall"):
        out |= {f"{k}_mean": mean[k], f"{k}_std": std[k]}
    paired = inner.sum(axis=1) > 1
    return out | {
        "rise_fall_ratio": np.where(mean["fall"] > 0, mean["rise"] / (mean["fall"] + 1e-8), 0), "iv_mean": mean["iv"], "iv_std": std["iv"],
        "iv_cv": np.where(paired, std["iv"] / (mean["iv"] + 1e-8), 0), "peak_bpm": np.where(paired, 60 / (mean["iv"] + 1e-8), 0),
    }


@cache
def _decay(n: int, half_life: float) -> np.ndarray:
    """Column t holds what each sample counts in the exponentially weighted level after sample t, the first one being its seed."""
    keep = 0.5 ** (1 / half_life)
    age = np.arange(n) - np.arange(n)[:, None]
    weights = np.where(age >= 0, (1 - keep) * keep ** np.maximum(age, 0), 0.0)
    weights[0] = keep ** np.arange(n)
    return weights


def recency(x: np.ndarray, half_life: float, rate: float) -> Columns:
    """Level, deviation about the level at the time, and level less the plain mean. half_life in seconds."""
    weights = _decay(x.shape[1], half_life * rate)
    level = x @ weights
    spread = ((x - level) ** 2) @ weights[:, -1]
    tag = f"ewma_hl{float(half_life)}".replace(".", "p")
    return {f"{tag}_level": level[:, -1], f"{tag}_std": np.sqrt(spread + 1e-12), f"{tag}_momentum": level[:, -1] - x.mean(axis=1)}


def seconds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and energy of each second."""
    parts = x.reshape(len(x), SECONDS, -1)
    return parts.mean(axis=2), parts.std(axis=2), (parts * parts).sum(axis=2)


def growth(energy: np.ndarray) -> Columns:
    """The exponential through the seconds' energies."""
    logs = np.log(energy + 1e-6)
    rate = slopes(logs)
    return {"exp_trend_rate": rate, "exp_trend_logscale": logs.mean(axis=1) - rate * (SECONDS - 1) / 2}


def contrast(mean: np.ndarray, std: np.ndarray) -> Columns:
    return {"recency_mean_delta": mean[:, -1] - mean[:, 0], "recency_std_delta": std[:, -1] - std[:, 0]}


def motion(axes: np.ndarray) -> Columns:
    """axes: (n, 3, samples)."""
    x, y, z = axes.transpose(1, 0, 2)
    jerk = np.linalg.norm(np.diff(axes, axis=2) * MOTION_HZ, axis=1)
    return {
        "xy_interact": (x * y).mean(axis=1), "xz_interact": (x * z).mean(axis=1), "yz_interact": (y * z).mean(axis=1), "sma": np.abs(axes).sum(axis=1).mean(axis=1),
        "jerk_mean": jerk.mean(axis=1), "jerk_std": jerk.std(axis=1), "jerk_energy": (jerk * jerk).sum(axis=1),
    }


def tonic(x: np.ndarray, width: int) -> Columns:
    """Slope of the trailing mean, and what is left over it."""
    sums = np.cumsum(x, axis=1)
    count = np.minimum(np.arange(1, x.shape[1] + 1), width)
    slow = (sums - np.pad(sums, ((0, 0), (width, 0)))[:, : x.shape[1]]) / count
    fast = x - slow
    return {"tonic_slope": slopes(slow), "phasic_std": fast.std(axis=1), "phasic_range": np.ptp(fast, axis=1)}


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Of all lags, over the energy."""
    centred = x - x.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(centred, 2 * x.shape[1], axis=1)) ** 2
    products = np.fft.irfft(power, axis=1)[:, : x.shape[1]]
    return products / ((centred * centred).sum(axis=1, keepdims=True) + 1e-8)


def lags(rate: float) -> tuple[int, int]:
    return int(np.floor(60 * rate / HIGH_BPM)), int(np.ceil(60 * rate / LOW_BPM))


def period(x: np.ndarray, rate: float) -> Columns:
    first, last = lags(rate)
    near = autocorrelation(x)[:, first : last + 1]
    return {"autocorr_bpm": 60 * rate / (first + near.argmax(axis=1)), "autocorr_peak": near.max(axis=1)}


def periods(x: np.ndarray, rate: float, harmonics: int = 3, guard: int = 3) -> Columns:
    """The best lag, the best one more than guard lags off, and the lag whose multiples correlate best on average; and the
    squares of all of these."""
    first, last = lags(rate)
    whole, every = autocorrelation(x), np.arange(len(x))
    near, lag = whole[:, first : last + 1], np.arange(first, last + 1)
    best = near.argmax(axis=1)
    others = np.where(np.abs(np.arange(len(lag)) - best[:, None]) > guard, near, -np.inf)
    second, score = others.argmax(axis=1), sum(whole[:, lag * h] for h in range(1, harmonics + 1)) / harmonics
    joint = score.argmax(axis=1)
    top, runner = near[every, best], near[every, second]
    out = {
        "autocorr_bpm": 60 * rate / lag[best], "autocorr_peak": top, "autocorr_bpm2": 60 * rate / lag[second], "autocorr_peak2": runner,
        "autocorr_peak_ratio": runner / (np.abs(top) + 1e-8), "harmonic_bpm": 60 * rate / lag[joint], "harmonic_score": score[every, joint],
    }
    return out | {f"{k}_sq": v**2 for k, v in out.items()}


def against_last(x: np.ndarray, length: int, step: int) -> Columns:
    """Correlation of the last length samples with each earlier stretch, step apart."""
    centre = lambda v: v - v.mean(axis=-1, keepdims=True)
    last = centre(x[:, -length:])
    parts = centre(np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, : x.shape[1] - length : step])
    found = np.einsum("ikj,ij->ik", parts, last) / np.sqrt((parts * parts).sum(axis=2) * (last * last).sum(axis=1)[:, None] + 1e-8)
    return {f"xcorr_off{step * k}": v for k, v in enumerate(found.T)}


# ------------------------------------------------------------------ feature sets


def _named(prefix: str, *found: Columns) -> Columns:
    return {f"{prefix}_{k}": v for columns in found for k, v in columns.items()}


def _all_stats(pulse: np.ndarray, axes: np.ndarray, skin: np.ndarray) -> Columns:
    signals = {"acc_x": axes[:, 0], "acc_y": axes[:, 1], "acc_z": axes[:, 2], "acc_mag": np.linalg.norm(axes, axis=1), "bvp": pulse, "eda": skin}
    out: Columns = {}
    for name, x in signals.items():
        out |= _named(name, stats(x))
    return out


def plain(pulse: np.ndarray, axes: np.ndarray, skin: np.ndarray) -> Columns:
    """Statistics of every signal, and the pulse's best lag."""
    return _all_stats(pulse, axes, skin) | _named("bvp", period(pulse, PULSE_HZ))


def correlated(pulse: np.ndarray, axes: np.ndarray, skin: np.ndarray) -> Columns:
    """plain, and the correlations of the last second with every earlier stretch."""
    return plain(pulse, axes, skin) | _named("bvp", against_last(pulse, 64, 8))


def shaped(pulse: np.ndarray, axes: np.ndarray, skin: np.ndarray, harmonic: bool = False) -> Columns:
    """Shapes, recency and trends, without any correlation; with harmonic also the lags and their squares."""
    size = np.linalg.norm(axes, axis=1)
    out = _all_stats(pulse, axes, skin)
    mean, std, energy = seconds(pulse)
    out |= _named("bvp", skewness(pulse), crossings(pulse, PULSE_HZ), curvature(pulse), morphology(pulse, PULSE_HZ), recency(pulse, 0.5, PULSE_HZ), recency(pulse, 2.0, PULSE_HZ))
    out |= _named("bvp", *([periods(pulse, PULSE_HZ)] if harmonic else []), growth(energy), contrast(mean, std))
    mean, std, energy = seconds(size)
    trends = {f"block_{k}_slope": slopes(v) for k, v in (("mean", mean), ("std", std), ("energy", energy))}
    out |= _named("acc_mag", skewness(size), trends, recency(size, 1.0, MOTION_HZ), growth(energy), contrast(mean, std)) | _named("acc", motion(axes))
    ratio = pulse.var(axis=1) * pulse.shape[1] / (size.var(axis=1) * size.shape[1] + 1e-6)
    out |= {"motion_pulse_to_motion_ratio": ratio, "motion_pulse_to_motion_log_ratio": np.log1p(ratio)}
    return out | _named("eda", tonic(skin, 4), recency(skin, 3.0, SKIN_HZ))


def harmonic(pulse: np.ndarray, axes: np.ndarray, skin: np.ndarray) -> Columns:
    return shaped(pulse, axes, skin, True)
