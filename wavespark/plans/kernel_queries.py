"""Queries of the batch kernels, which SQL has no words for; tests hold them against direct computation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import physio, surfaces
from ..operators.joins import place_in_order
from ..operators.kernels import apply_kernel, names_of
from ..operators.ordered import durable
from . import rates, tasks
from .fixtures import WINDOWS_SQL, channels, r6, rounded, table, windows

FLAT = surfaces.log_prior(np.ones(len(surfaces.BPM)))


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = channels(spark, sf_dir)
    return c.select("row_id", "bvp", F.concat("acc_x", "acc_y", "acc_z").alias("motion"), "eda")


def surface_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 196 columns of each window."""
    return apply_kernel(_inputs(spark, sf_dir), tasks.scalar_kernel(FLAT), tasks.C_WIDTHS, ["row_id"])


def bump_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1,960 columns of each window, as one array."""
    rows = _inputs(spark, sf_dir).withColumn("y", F.lit(None).cast("double"))
    return _design(spark, sf_dir, rows, False)


def full_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5,032 columns of each window: with the 2,172 tensors and ten distributions of 90."""
    rows = _inputs(spark, sf_dir).withColumn("y", F.lit(None).cast("double"))
    return _design(spark, sf_dir, rows, True)


def _design(spark: SparkSession, sf_dir: str, rows: DataFrame, full: bool) -> DataFrame:
    scalars = surface_scalars(spark, sf_dir).persist()
    knots = tasks.fit_knots_c(scalars, names_of(tasks.scalar_kernel(FLAT), tasks.C_WIDTHS), full)
    scalars.unpersist()
    return tasks.design_c(rows, FLAT, knots).select("row_id", "x")


#: Samples of a five-minute window of each channel, and the step between them in the samples of 300 vectors.
SPANS = {"e4_bvp": (19200, 1), "e4_hr": (300, 64), "e4_eda": (1200, 16), "e4_temp": (1200, 17), "e4_acc": (28800, 7), "zephyr_ecg": (75000, 3), "zephyr_acc": (90000, 5), "zephyr_breathing": (7500, 11)}


def subject_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 343 columns of five-minute windows of eight channels, made from 300 vectors of embeddings each."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", A.doubles(F.col("embedding")).alias("w"))
    group = F.floor(F.col("vec_id") / 300)
    pool = vectors.groupBy(group.alias("k")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "w"))).alias("parts")).where(F.size("parts") == 300)  # 300 rows a group
    pool = pool.select("k", F.flatten(F.transform("parts", lambda p: p["w"])).alias("pool"))
    cut = lambda n, step: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get("pool", i * step % F.lit(19200)))
    taken = {c: cut(*span) for c, span in SPANS.items()}
    rows = pool.select(F.col("k").cast("string").alias("subject_id"), F.lit(0.0).alias("ts"), F.lit(None).cast("double").alias("glucose"), *[v.alias(c) for c, v in taken.items()])
    return tasks.subject_features(rows).drop("ts", "glucose")


BANDS = {"low": (0.5, 2.0), "mid": (2.0, 8.0), "high": (8.0, 32.0)}
#: One Hann segment of a window of ten seconds: its density at k / 10 Hz.
WELCH_SQL = f"""{WINDOWS_SQL}, h AS (SELECT row_id, pos, (v - avg(v) OVER (PARTITION BY row_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 640)) AS x FROM w),
k AS (SELECT unnest(range(0, 321)) AS k), y AS (SELECT row_id, k, sum(x * cos(2 * pi() * ((k * pos) % 640) / 640)) AS c, sum(x * sin(2 * pi() * ((k * pos) % 640) / 640)) AS s FROM h, k GROUP BY 1, 2),
d AS (SELECT row_id, k / 10::DOUBLE AS f, (c * c + s * s) / (64 * 240) * CASE WHEN k IN (0, 320) THEN 1 ELSE 2 END AS p FROM y),
t AS (SELECT row_id, f, p, sum(p) OVER (PARTITION BY row_id) + 1e-20::DOUBLE AS total FROM d)"""


def _band_sql(name: str, low: float, high: float) -> str:
    inside = f"coalesce(sum(p) FILTER (WHERE f >= {low} AND f < {high}), 0)"
    return f"{r6(f'ln({inside} + 1e-12::DOUBLE)', f'w_lp_{name}')}, {r6(f'{inside} / any_value(total)', f'w_rp_{name}')}"


WELCH_BANDS_SQL = f"""WITH {WELCH_SQL} SELECT row_id, {', '.join(_band_sql(k, a, b) for k, (a, b) in BANDS.items())}, {r6('sum(p / total * f)', 'w_centroid')},
{r6('-sum(p / total * ln(p / total + 1e-12::DOUBLE))', 'w_sent')}, {r6('ln(any_value(total))', 'w_ltot')}, {r6('max_by(f, struct_pack(p := p, l := -f))', 'w_fpeak')} FROM t GROUP BY row_id"""


def evidence_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The autoregressive, periodogram and combined surfaces of each window, by 90 coarse candidates."""

    def kernel(a: dict, n: int) -> dict:
        found = surfaces.evidence(a["bvp"], a["motion"].reshape(n, 3, 320), FLAT)
        found["S"] = surfaces.combine(found, surfaces.MAIN)
        coarse = {k: surfaces.coarsen(surfaces.softmax(found[k])) for k in ("lAR", "lP", "S")}
        return {f"{k}_{j:02}": v[:, j] for k, v in coarse.items() for j in range(90)}

    return apply_kernel(_inputs(spark, sf_dir), kernel, tasks.C_WIDTHS, ["row_id"])


def welch_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(apply_kernel(windows(spark, sf_dir), lambda a, n: physio.band_powers(a["w"], 64, BANDS, "w"), {"w": 640}, ["row_id"]), ["row_id"])


def beat_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered, beats found, and their intervals' statistics."""

    def kernel(a: dict, n: int) -> dict:
        beats = physio.detect_beats(physio.zero_phase(physio.impute(a["w"]), 64, 0.7, 3.5), 64, 0.3)
        return physio.intervals(beats, 64, "ppg")

    return apply_kernel(windows(spark, sf_dir), kernel, {"w": 640}, ["row_id"])


def beat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    def kernel(a: dict, n: int) -> dict:
        fine = physio.zero_phase(physio.impute(a["w"]), 64, 0.7, 3.5)
        return physio.mean_beat(fine, physio.detect_beats(fine, 64, 0.3), 64, 0.2, 0.45, 24, "ppg")

    return apply_kernel(windows(spark, sf_dir), kernel, {"w": 640}, ["row_id"])


def skin_and_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the skin and motion channels."""

    def kernel(a: dict, n: int) -> dict:
        return physio.signal_stats(a["eda"], "eda") | physio.acceleration(a["motion"].reshape(n, 3, 320).transpose(0, 2, 1), "e4acc")

    return apply_kernel(_inputs(spark, sf_dir), kernel, {"eda": 40, "motion": 960}, ["row_id"])


#: Skin samples: every 16th, made positive.
SKIN_SQL = f"""{WINDOWS_SQL}, e AS (SELECT row_id, pos // 16 AS pos, abs(v) AS v FROM w WHERE pos % 16 = 0),
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY row_id ORDER BY pos)) AS d FROM e)"""


def _stats_sql(tag: str, n: int) -> str:
    """The sixteen statistics of n samples without holes."""
    q = lambda at: f"quantile_cont(v, {at})"
    of = {
        "mean": "avg(v)", "std": "stddev_pop(v)", "min": "min(v)", "max": "max(v)", "rng": "max(v) - min(v)", "mad": "avg(d)",
        "slope": f"avg(v * (pos - {(n - 1) / 2}::DOUBLE) / (sqrt({n * n - 1} / 12::DOUBLE) + 1e-9::DOUBLE))", "cv": "stddev_pop(v) / (abs(avg(v)) + 1e-6::DOUBLE)", "valid": "1",
        "q5": q(0.05), "q25": q(0.25), "q50": q(0.5), "q75": q(0.75), "q95": q(0.95), "iqr9": f"{q(0.95)} - {q(0.05)}", "miss": "0",
    }
    return ", ".join(r6(v, f"{tag}_{k}") for k, v in of.items())


def skin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of the skin channel alone."""
    return rounded(apply_kernel(_inputs(spark, sf_dir), lambda a, n: physio.signal_stats(a["eda"], "eda"), {"eda": 40}, ["row_id"]), ["row_id"])


def rate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of each window's mean label by the gated, shaped and harmonic variants, fitted on all windows."""
    label = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("row_id")).agg(F.avg("label").alias("y"))
    rows = _inputs(spark, sf_dir).join(label, "row_id")
    placed = place_in_order(rows.withColumn("_all", F.lit(0)), "_all", "row_id", "row_id")
    rows = durable(placed.withColumn("row_id", F.col("_place") - 1).drop("_all", "_place", "_count"))
    n, out = rows.count(), None
    for name in ("gated", "shaped", "harmonic"):
        found = rates.fit(rows, n, rates.VARIANTS[name]).predict(rows).select(F.lit(name).alias("variant"), "row_id", "p")
        out = found if out is None else out.unionAll(found)
    return out


def _some(df: DataFrame, kernel, widths: dict[str, int], names: list[str]) -> DataFrame:
    """Some of a kernel's columns, by name."""
    return rounded(apply_kernel(df, lambda a, n: {k: v for k, v in kernel(a, n).items() if k in names}, widths, ["row_id"]), ["row_id"])


RESPONSE = ["eda_tonic_mean", "eda_tonic_std", "eda_phasic_std", "eda_phasic_amp", "eda_lphasic", "eda_drift", "eda_scr_frac", "eda_scr_n"]
RESPONSE_SQL = f"""WITH {WINDOWS_SQL}, e AS (SELECT row_id, pos // 16 AS pos, abs(v) AS v FROM w WHERE pos % 16 = 0),
t AS (SELECT a.row_id, a.pos, any_value(a.v) AS v, avg(b.v) AS slow FROM e a, range(-40, 40) k(k) JOIN e b ON b.row_id = a.row_id AND b.pos = greatest(0, least(39, a.pos + k)) GROUP BY 1, 2),
q AS (SELECT row_id, 0.8::DOUBLE * (quantile_cont(abs(v - slow), 0.95) + 1e-6::DOUBLE) AS strong FROM t GROUP BY 1)
SELECT row_id, {r6('avg(slow)', 'eda_tonic_mean')}, {r6('stddev_pop(slow)', 'eda_tonic_std')}, {r6('stddev_pop(v - slow)', 'eda_phasic_std')}, {r6('avg(abs(v - slow))', 'eda_phasic_amp')},
{r6('ln(stddev_pop(v - slow) + 1e-4::DOUBLE)', 'eda_lphasic')}, {r6('max_by(slow, pos) - min_by(slow, pos)', 'eda_drift')}, {r6('avg((abs(v - slow) > 0.02::DOUBLE)::INTEGER)', 'eda_scr_frac')},
{r6('sum((abs(v - slow) > strong)::INTEGER)', 'eda_scr_n')} FROM t JOIN q USING (row_id) GROUP BY row_id"""


def skin_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slow part of the skin channel and the responses over it."""
    return _some(_inputs(spark, sf_dir), lambda a, n: physio.eda(a["eda"]), {"eda": 40}, RESPONSE)


TRENDS_SQL = f"""WITH {WINDOWS_SQL}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY row_id ORDER BY pos) AS d FROM w)
SELECT row_id, {r6('avg(v) FILTER (WHERE pos >= 400) - avg(v) FILTER (WHERE pos < 240)', 'temp_delta')}, {r6('avg(abs(d))', 'e4hr_absdiff')}, {r6('stddev_pop(d)', 'e4hr_dstd')},
{r6('avg(v) FILTER (WHERE pos >= 580) - avg(v) FILTER (WHERE pos < 60)', 'e4hr_delta')} FROM d GROUP BY row_id"""


def slow_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trends of the temperature and heart-rate channels, of the pulse taken as either."""
    return _some(windows(spark, sf_dir), lambda a, n: physio.temperature(a["w"]) | physio.heart_rate(a["w"]), {"w": 640}, ["temp_delta", "e4hr_absdiff", "e4hr_dstd", "e4hr_delta"])


MOVEMENT = [f"e4acc_{k}" for k in ("enmo", "lhp", "still", "jerk", "m0", "m1", "m2", "s0", "s1", "s2")]
MOVEMENT_SQL = f"""WITH {WINDOWS_SQL}, i AS (SELECT unnest(range(0, 320)) AS i),
m AS (SELECT a.row_id, i, a.v AS x, b.v AS y, c.v AS z, sqrt(a.v ^ 2 + b.v ^ 2 + c.v ^ 2) AS g FROM i JOIN w a ON a.pos = i JOIN w b ON b.row_id = a.row_id AND b.pos = i + 320 JOIN w c ON c.row_id = a.row_id AND c.pos = 2 * i),
mv AS (SELECT a.row_id, a.i, any_value(a.g) - avg(b.g) AS moving FROM m a, range(-32, 32) k(k) JOIN m b ON b.row_id = a.row_id AND b.i = greatest(0, least(319, a.i + k)) GROUP BY 1, 2),
q AS (SELECT row_id, median(g) AS g0, stddev_pop(moving) AS spread FROM m JOIN mv USING (row_id, i) GROUP BY 1),
d AS (SELECT *, abs(g - lag(g) OVER (PARTITION BY row_id ORDER BY i)) AS j FROM m JOIN mv USING (row_id, i) JOIN q USING (row_id))
SELECT row_id, {r6('avg(greatest(g - g0, 0))', 'e4acc_enmo')}, {r6('ln(any_value(spread) + 1e-4::DOUBLE)', 'e4acc_lhp')}, {r6('avg((abs(moving) < 0.02::DOUBLE * (spread + 1e-6::DOUBLE))::INTEGER)', 'e4acc_still')},
{r6('avg(j)', 'e4acc_jerk')}, {', '.join(r6(f'avg({c})', f'e4acc_m{k}') + ', ' + r6(f'stddev_pop({c})', f'e4acc_s{k}') for k, c in enumerate('xyz'))} FROM d GROUP BY row_id"""


def movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the motion channel's length and axes."""
    return _some(_inputs(spark, sf_dir), lambda a, n: physio.acceleration(a["motion"].reshape(n, 3, 320).transpose(0, 2, 1), "e4acc"), {"motion": 960}, MOVEMENT)


SKIN_SHAPE_SQL = f"""WITH {WINDOWS_SQL}, e AS (SELECT row_id, pos // 16 AS pos, abs(v) AS v FROM w WHERE pos % 16 = 0)
SELECT row_id, {r6('ln(avg(v) + 1e-3::DOUBLE)', 'e_lmean')}, {r6('ln(stddev_pop(v) + 1e-4::DOUBLE)', 'e_lstd')}, {r6('sum(v * (pos - 19.5::DOUBLE)) / sqrt((1600 - 1) / 12::DOUBLE) / 40', 'e_slope')},
{r6('CASE WHEN max(v) > 1e-6 THEN 0 ELSE 1 END', 'e_zero')}, {r6('ln(max(v) - min(v) + 1e-4::DOUBLE)', 'e_lrng')} FROM e GROUP BY row_id"""


def skin_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five skin columns of a ten-second window."""
    return rounded(apply_kernel(_inputs(spark, sf_dir), lambda a, n: surfaces.skin_shape(a["eda"]), {"eda": 40}, ["row_id"]), ["row_id"])


PRIOR_SQL = """WITH c AS (SELECT unnest(range(0, 360)) AS k), n AS (SELECT k, count(e.value) AS n FROM c LEFT JOIN events e ON floor((e.value - 35.75::DOUBLE) / 0.5::DOUBLE) = k GROUP BY 1), t AS (SELECT greatest(sum(n), 1) AS t FROM n),
h AS (SELECT j, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (j + 10) / 20) AS h FROM (SELECT unnest(range(-10, 11)) AS j)), s AS (SELECT c.k, sum(n.n / t.t * h.h / 10) + 1e-6::DOUBLE AS p FROM c, t, h LEFT JOIN n ON n.k = c.k - h.j GROUP BY 1)
""" + f"SELECT k::INTEGER AS k, {r6('ln(p / sum(p) OVER ())', 'log_prior')} FROM s"


def target_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log prior of 360 candidates, of the events' values taken as targets."""
    rows = table(spark, sf_dir, "events")
    prior = tasks.fit_prior(rows, "value")
    return rounded(spark.createDataFrame([(k, float(v)) for k, v in enumerate(prior)], "k int, log_prior double"), ["k"])


QUERIES = {
    f.__name__: f
    for f in (surface_scalars, bump_design, full_design, evidence_surfaces, welch_bands, beat_intervals, beat_template, skin_and_motion, skin_stats, subject_features, rate_predictions, skin_response, slow_channels, movement, skin_shape, target_prior)
}
ORACLE_SQL: dict[str, str] = {
    "welch_bands": WELCH_BANDS_SQL,
    "skin_response": RESPONSE_SQL,
    "slow_channels": TRENDS_SQL,
    "movement": MOVEMENT_SQL,
    "skin_shape": SKIN_SHAPE_SQL,
    "target_prior": PRIOR_SQL,
    "skin_stats": f"WITH {SKIN_SQL} SELECT row_id, {_stats_sql('eda', 40)} FROM d GROUP BY row_id",
}
