"""Window operators as Column expressions over ARRAY<DOUBLE>: narrow, without a shuffle and without Python.

A window is one array column. Where a value is needed for each sample, let() binds it once: a lambda's free expressions
are otherwise evaluated again for every element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(w: Column) -> Column:
    return w.cast("array<double>")


def constant(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def total(w: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(w, F.lit(0.0), lambda a, x: a + of(x))


def mean(w: Column, of: Callable[[Column], Column] = lambda x: x) -> Column:
    return total(w, of) / F.size(w)


def energy(w: Column) -> Column:
    return total(w, lambda x: x * x)


def std(w: Column) -> Column:
    """Population standard deviation."""
    return let(mean(w), lambda m: F.sqrt(mean(w, lambda x: (x - m) * (x - m))))


def moment(w: Column, power: int, epsilon: float) -> Column:
    """Mean of ((x - mean) / (std + epsilon)) ** power."""
    return let(mean(w), lambda m: let(std(w) + epsilon, lambda s: mean(w, lambda x: F.pow((x - m) / s, F.lit(float(power))))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def quantile_sorted(s: Column, q: float) -> Column:
    """Of a sorted array, by linear interpolation."""
    n = F.size(s)
    return let((n - 1) * F.lit(q), lambda at: let(F.floor(at).cast("int"), lambda k: F.get(s, k) + (F.get(s, F.least(k + 1, n - 1)) - F.get(s, k)) * (at - k)))


def quantile(w: Column, q: float) -> Column:
    return let(F.array_sort(w), lambda s: quantile_sorted(s, q))


def diff(w: Column) -> Column:
    return F.zip_with(F.slice(w, 2, F.size(w) - 1), F.slice(w, 1, F.size(w) - 1), lambda b, a: b - a)


def slope(w: Column) -> Column:
    """Least-squares slope against 0, 1, ...; 0 for one sample."""
    n = F.size(w).cast("double")
    spread = n * (n * n - 1) / 12
    centred = F.transform(w, lambda x, i: x * (i - (n - 1) / 2))
    return F.when(n > 1, total(centred) / spread).otherwise(0.0)


def stats(w: Column, prefix: str = "") -> dict[str, Column]:
    """The eleven statistics of a signal."""
    d = diff(w)
    return {
        f"{prefix}mean": mean(w), f"{prefix}std": std(w), f"{prefix}min": F.array_min(w), f"{prefix}max": F.array_max(w),
        f"{prefix}median": quantile(w, 0.5), f"{prefix}q25": quantile(w, 0.25), f"{prefix}q75": quantile(w, 0.75),
        f"{prefix}energy": energy(w), f"{prefix}diff_mean": mean(d), f"{prefix}diff_std": std(d), f"{prefix}slope": slope(w),
    }


def finite(w: Column) -> Column:
    """The finite samples."""
    return F.filter(w, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def impute_median(w: Column) -> Column:
    """Samples that aren't finite replaced by the median of those that are; by 0 if none is."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fill = F.when(F.size(finite(w)) > 0, quantile(finite(w), 0.5)).otherwise(0.0)
    return let(fill, lambda m: F.transform(w, lambda x: F.when(ok(x), x).otherwise(m)))


def safe(v: Column, fill: float = 0.0, most: float = 1e12) -> Column:
    """Clipped to +-most; fill where it isn't finite."""
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(bad, fill).otherwise(F.greatest(F.lit(-most), F.least(F.lit(most), v)))


def nan_stats(w: Column, prefix: str = "") -> dict[str, Column]:
    """Sixteen statistics of a signal with missing samples (NaN, infinite or null); all are finite, 0 if none is left.
    Slope is the mean of x times standardised time over the samples that are there."""
    n = F.size(w).cast("double")
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    f = finite(w)
    s = F.array_sort(f)
    at = lambda k: let(s, lambda a: quantile_sorted(a, k / 100))
    q = {k: at(k) for k in (5, 25, 50, 75, 95)}
    steps = F.filter(
        F.zip_with(F.slice(w, 2, F.size(w) - 1), F.slice(w, 1, F.size(w) - 1), lambda b, a: F.when(ok(a) & ok(b), F.abs(b - a))),
        lambda x: x.isNotNull(),
    )
    time_std = F.sqrt((n * n - 1) / 12) + 1e-9
    timed = F.filter(F.transform(w, lambda x, i: F.when(ok(x), x * (i - (n - 1) / 2) / time_std)), lambda x: x.isNotNull())
    avg = lambda a: F.when(F.size(a) > 0, mean(a))
    valid = F.size(f) / n
    raw = {
        "mean": avg(f), "std": F.when(F.size(f) > 0, std(f)), "min": F.array_min(f), "max": F.array_max(f), "rng": F.array_max(f) - F.array_min(f),
        "mad": avg(steps), "slope": avg(timed), "cv": F.when(F.size(f) > 0, std(f) / (F.abs(mean(f)) + 1e-6)), "valid": valid,
        **{f"q{k}": F.when(F.size(f) > 0, v) for k, v in q.items()}, "iqr9": F.when(F.size(f) > 0, q[95] - q[5]), "miss": (valid < 0.5).cast("double"),
    }
    return {prefix + k: safe(v) for k, v in raw.items()}


def blocks(w: Column, count: int, length: int) -> Column:
    """The first count * length samples as an array of arrays."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.slice(w, b * length + 1, F.lit(length)))


def subwindows(w: Column, length: int, hop: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - length, F.lit(hop)), lambda s: F.slice(w, s + 1, F.lit(length)))


def block_summary(w: Column, count: int, length: int) -> dict[str, Column]:
    b = blocks(w, count, length)
    return {"mean": F.transform(b, lambda x: mean(x)), "std": F.transform(b, lambda x: std(x)), "energy": F.transform(b, lambda x: energy(x))}


def intercept(w: Column) -> Column:
    """Of the least-squares line against 0, 1, ..."""
    return mean(w) - slope(w) * (F.size(w) - 1) / 2


def zscore(w: Column, epsilon: float = 1e-8) -> Column:
    return let(mean(w), lambda m: let(std(w) + epsilon, lambda s: F.transform(w, lambda x: (x - m) / s)))


def normalised_square(w: Column) -> Column:
    """x squared over its mean, of the finite samples' squares."""
    return let(mean(finite(w), lambda x: x * x), lambda m: F.transform(w, lambda x: x * x / m))


def zero_crossings(w: Column) -> Column:
    """Sign changes of the centred signal; zero counts as positive."""
    sign = let(mean(w), lambda m: F.transform(w, lambda x: F.when(x - m >= 0, 1.0).otherwise(-1.0)))
    return let(sign, lambda s: total(F.zip_with(F.slice(s, 2, F.size(s) - 1), F.slice(s, 1, F.size(s) - 1), lambda a, b: F.when(a != b, 1.0).otherwise(0.0))))


def zero_crossing_bpm(w: Column, rate: float) -> Column:
    return zero_crossings(w) / 2 * 60 / ((F.size(w) - 1) / F.lit(float(rate)))


def ewma(w: Column, half_life: float) -> dict[str, Column]:
    """Exponentially weighted level, deviation and momentum (level less the plain mean) at the end, seeded with the first
    sample; half_life in samples. The variance averages squared distances from the level at their time."""
    keep = float(0.5 ** (1 / half_life))
    first = F.get(w, F.lit(0))
    state = lambda level, var: F.struct(level.alias("level"), var.alias("var"))

    def step(s: Column, x: Column) -> Column:
        level = F.lit(keep) * s["level"] + F.lit(1 - keep) * x
        return state(level, F.lit(keep) * s["var"] + F.lit(1 - keep) * (x - level) * (x - level))

    end = F.aggregate(F.slice(w, 2, F.size(w) - 1), state(first, F.lit(0.0)), step)
    return {"level": end["level"], "std": F.sqrt(end["var"] + 1e-12), "momentum": end["level"] - mean(w)}


def trailing_mean(w: Column, width: int) -> Column:
    """Mean of up to width samples ending at each."""
    return F.transform(w, lambda _, i: mean(F.slice(w, F.greatest(i - width + 2, F.lit(1)), F.least(i + 1, F.lit(width)))))


def centred_mean(w: Column, width: int) -> Column:
    """Moving average with the ends repeated: width // 2 samples before, the rest after."""
    before, after = width // 2, width - 1 - width // 2
    padded = F.concat(F.array_repeat(F.get(w, F.lit(0)), before), w, F.array_repeat(F.element_at(w, -1), after))
    return let(padded, lambda p: F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: mean(F.slice(p, i, F.lit(width)))))


def band_pass(w: Column, short: int, long: int) -> Column:
    return F.zip_with(centred_mean(w, short), centred_mean(w, long), lambda a, b: a - b)


def lag_product(c: Column, lag: Column | int) -> Column:
    """Sum of x[t] * x[t + lag]."""
    lag = F.lit(lag) if isinstance(lag, int) else lag
    n = F.size(c) - lag
    return total(F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, lag + 1, n), lambda a, b: a * b))


def autocorrelation(w: Column, first: int, last: int) -> Column:
    """Of the centred signal at lags first..last, over its energy; not corrected for the shrinking overlap."""
    centred = let(mean(w), lambda m: F.transform(w, lambda x: x - m))
    return let(centred, lambda c: let(energy(c) + 1e-8, lambda e: F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: lag_product(c, k) / e)))


def first_argmax(w: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return F.array_position(w, F.array_max(w)).cast("int") - 1


def lag_range(rate: float, low_bpm: float, high_bpm: float) -> tuple[int, int]:
    return int(np.floor(60 * rate / high_bpm)), int(np.ceil(60 * rate / low_bpm))


def autocorr_bpm(w: Column, rate: float, low: float = 40, high: float = 200) -> dict[str, Column]:
    a, b = lag_range(rate, low, high)
    found = autocorrelation(w, a, b)
    return {"bpm": let(found, lambda c: F.lit(60.0 * rate) / (first_argmax(c) + a)), "peak": F.array_max(found)}


def harmonic_bank(w: Column, rate: float, low: float = 40, high: float = 200, harmonics: int = 3, guard: int = 3) -> Column:
    """Struct: rate and correlation of the best lag; of the best one more than guard lags off; the ratio of the two
    correlations; and rate and score of the lag whose multiples correlate best on average."""
    a, b = lag_range(rate, low, high)
    bpm = lambda k: F.lit(60.0 * rate) / (k + a)

    def of(c: Column) -> Column:
        near = F.slice(c, 1, b - a + 1)
        score = F.transform(near, lambda x, i: reduce(lambda s, h: s + F.get(c, (i + a) * h - a), range(2, harmonics + 1), x) / harmonics)
        return let(near, lambda n: let(first_argmax(n), lambda k: let(score, lambda s: second(n, k, s))))

    def second(near: Column, k: Column, score: Column) -> Column:
        others = F.transform(near, lambda x, i: F.when(F.abs(i - k) > guard, x).otherwise(float("-inf")))
        return let(first_argmax(others), lambda j: let(first_argmax(score), lambda h: F.struct(
            bpm(k).alias("bpm1"), F.get(near, k).alias("c1"), bpm(j).alias("bpm2"), F.get(near, j).alias("c2"),
            (F.get(near, j) / (F.abs(F.get(near, k)) + 1e-8)).alias("ratio"), bpm(h).alias("harmonic_bpm"), F.get(score, h).alias("harmonic_score"),
        )))

    return let(autocorrelation(w, a, b * harmonics), of)


def sliding_correlation(w: Column, length: int, step: int) -> Column:
    """Centred correlation of the last length samples with each earlier stretch, step apart, the end itself left out."""
    centre = lambda s: let(mean(s), lambda m: F.transform(s, lambda x: x - m))
    ref = centre(F.slice(w, -length, length))
    starts = F.sequence(F.lit(0), F.size(w) - length - 1, F.lit(step))
    return let(ref, lambda r: let(energy(r), lambda e: F.transform(starts, lambda s: let(centre(F.slice(w, s + 1, F.lit(length))), lambda c: dot(r, c) / F.sqrt(e * energy(c) + 1e-8)))))


def local_maxima(w: Column) -> Column:
    """Indices of samples above both neighbours."""
    inner = F.sequence(F.lit(1), F.size(w) - 2)
    return F.filter(inner, lambda i: (F.get(w, i) > F.get(w, i - 1)) & (F.get(w, i) > F.get(w, i + 1)))


def local_minima(w: Column) -> Column:
    return local_maxima(F.transform(w, lambda x: -x))


def peak_intervals(w: Column, rate: float) -> dict[str, Column]:
    """Number of local maxima; mean, deviation and relative deviation of the seconds between them; their rate. Zeros for
    fewer than two."""
    p = F.transform(local_maxima(w), lambda i: i / F.lit(float(rate)))
    gaps = diff(p)
    some = F.size(p) > 1
    m, s = mean(gaps), std(gaps)
    of = lambda v: F.when(some, v).otherwise(0.0)
    return {"count": F.size(p).cast("double"), "mean_interval": of(m), "std_interval": of(s), "cv_interval": of(s / (m + 1e-8)), "bpm": of(60 / (m + 1e-8))}


def poly_trend(w: Column, n: int, degree: int = 3) -> list[Column]:
    """Least-squares coefficients c1..c_degree over time scaled to [-1, 1]; n is the window's length. The fit is linear in
    the samples, so it is a product with a constant matrix."""
    t = np.linspace(-1, 1, n)
    solve = np.linalg.pinv(np.vander(t, degree + 1, increasing=True))
    return [dot(w, constant(solve[k])) for k in range(1, degree + 1)]


def gate(c: Column, lam: float, gain: float = 0.6, steep: float = 12.0) -> Column:
    """Correlations amplified above lam and damped below it."""
    return c * (1 + gain * F.tanh(steep * (F.abs(c) - lam)))


def log_safe(v: Column) -> Column:
    return F.ln(F.greatest(v, F.lit(1e-12)))


def softmax(w: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(w)
    return let(top, lambda m: let(F.transform(w, lambda x: F.exp((x - m) / temperature)), lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t))))


def cumulative_index(p: Column, q: float) -> Column:
    """First index at which the running sum reaches q; the last one if none does."""
    end = F.aggregate(
        p, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["below"] + F.when(s["sum"] + x < q, 1).otherwise(0)).alias("below")),
    )
    return F.least(end["below"], F.size(p) - 1)


def interpolate_at(w: Column, at: Column) -> Column:
    """Value between samples at a fractional index, clipped to the array."""
    k = F.least(F.greatest(at, F.lit(0.0)), F.size(w) - F.lit(1.001))
    return let(k, lambda x: let(F.floor(x).cast("int"), lambda i: F.get(w, i) * (1 - (x - i)) + F.get(w, i + 1) * (x - i)))


def parabolic_peak(w: Column, first: float, step: float) -> Column:
    """Value on the axis first, first + step, ... of the largest sample, refined by the parabola through it and its
    neighbours; the offset is at most one step."""
    k = F.least(F.greatest(first_argmax(w), F.lit(1)), F.size(w) - 2)

    def at(i: Column) -> Column:
        a, b, c = F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)
        bend = a - 2 * b + c
        shift = F.when(F.abs(bend) > 1e-12, 0.5 * (a - c) / bend).otherwise(0.0)
        return first + step * (i + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift)))

    return let(k, at)


def strongest(w: Column, count: int, guard: int) -> list[Column]:
    """Indices of the count largest samples, each more than guard samples from those before it."""
    out: list[Column] = []

    def free(i: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.abs(i - t) > guard for t in out], F.lit(True))

    for _ in range(count):
        out.append(first_argmax(F.transform(w, lambda x, i: F.when(free(i), x).otherwise(float("-inf")))))
    return out


def coarsen(w: Column, by: int) -> Column:
    """Sums of by samples each."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(w) / by).cast("int") - 1), lambda b: total(F.slice(w, b * by + 1, F.lit(by))))


def bumps(v: Column, knots: Column) -> Column:
    """Normalised Gaussian bumps of a value around sorted knots; the width is an eighth of the knots' range for nine."""
    width = (F.element_at(knots, -1) - F.get(knots, F.lit(0))) / (F.size(knots) - 1)
    raw = let(F.greatest(width, F.lit(1e-9)), lambda s: F.transform(knots, lambda k: F.exp(-0.5 * ((v - k) / s) * ((v - k) / s))))
    return let(raw, lambda r: let(total(r) + 1e-9, lambda t: F.transform(r, lambda x: x / t)))


def outer(a: Column, b: Column) -> Column:
    """All products, the second array's index running faster."""
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def every(w: Column, step: int) -> Column:
    return F.filter(w, lambda _, i: i % step == 0)


def axis_interactions(x: Column, y: Column, z: Column) -> dict[str, Column]:
    n = F.size(x)
    return {"xy": dot(x, y) / n, "xz": dot(x, z) / n, "yz": dot(y, z) / n}


def magnitude(x: Column, y: Column, z: Column) -> Column:
    squares = F.zip_with(F.zip_with(x, y, lambda a, b: a * a + b * b), z, lambda s, c: F.sqrt(s + c * c))
    return squares


def signal_magnitude_area(x: Column, y: Column, z: Column) -> Column:
    return mean(F.zip_with(F.zip_with(x, y, lambda a, b: F.abs(a) + F.abs(b)), z, lambda s, c: s + F.abs(c)))


def jerk(x: Column, y: Column, z: Column, rate: float) -> dict[str, Column]:
    j = F.transform(magnitude(diff(x), diff(y), diff(z)), lambda v: v * rate)
    return {"mean": mean(j), "std": std(j), "energy": energy(j)}


def correlation(a: Column, b: Column, epsilon: float = 1e-8) -> Column:
    return let(mean(a), lambda m: let(mean(b), lambda n: total(F.zip_with(a, b, lambda x, y: (x - m) * (y - n))))) / (F.size(a) * (std(a) + epsilon) * (std(b) + epsilon))
