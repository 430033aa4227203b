"""Queries over windows: column expressions, or long form where an operator is a frame or a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import tables
from ..operators import longform as L
from ..operators.ordered import durable, ewma, ewma_filled
from ..operators.quantiles import exact_quantiles, median
from .fixtures import SECONDS_SQL, WINDOWS_SQL, channels, r6, rounded, seconds, windows

QUERIES, ORACLE_SQL = {}, {}
RATE = 64.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def named(df: DataFrame, columns: dict) -> DataFrame:
    return rounded(df.select("row_id", *[c.alias(k) for k, c in columns.items()]), ["row_id"])


STATS = f"""avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, median(v) AS median, quantile_cont(v, 0.25) AS q25,
quantile_cont(v, 0.75) AS q75, sum(v * v) AS energy, avg(d) AS diff_mean, stddev_pop(d) AS diff_std, regr_slope(v, pos) AS slope"""
STAT_NAMES = ["mean", "std", "min", "max", "median", "q25", "q75", "energy", "diff_mean", "diff_std", "slope"]


@query(f"""WITH {SECONDS_SQL}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY row_id ORDER BY pos) AS d FROM s),
a AS (SELECT row_id, {STATS} FROM d GROUP BY row_id) SELECT row_id, {', '.join(r6(c, c) for c in STAT_NAMES)} FROM a""")
def window_signal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return named(seconds(spark, sf_dir), A.stats(w))


NAN = ["mean", "std", "min", "max", "rng", "mad", "slope", "cv", "valid", "q5", "q25", "q50", "q75", "q95", "iqr9", "miss"]


@query(f"""WITH {SECONDS_SQL}, m AS (SELECT row_id, pos, CASE WHEN (pos + row_id) % 7 > 0 AND row_id % 11 > 0 THEN v END AS v FROM s),
d AS (SELECT *, abs(v - lag(v) OVER (PARTITION BY row_id ORDER BY pos)) AS d FROM m),
a AS (SELECT row_id, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, max(v) - min(v) AS rng, avg(d) AS mad,
  avg(v * (pos - 31.5::DOUBLE) / (sqrt((64 * 64 - 1) / 12::DOUBLE) + 1e-9::DOUBLE)) AS slope, stddev_pop(v) / (abs(avg(v)) + 1e-6::DOUBLE) AS cv,
  count(v) / count(*) AS valid, quantile_cont(v, 0.05) AS q5, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.5) AS q50,
  quantile_cont(v, 0.75) AS q75, quantile_cont(v, 0.95) AS q95, quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS iqr9,
  CASE WHEN count(v) / count(*) < 0.5 THEN 1 ELSE 0 END AS miss FROM d GROUP BY row_id)
SELECT row_id, {', '.join(r6(f'coalesce({c}, 0)', c) for c in NAN)} FROM a""")
def window_nan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    df = seconds(spark, sf_dir)
    holes = F.transform(w, lambda x, i: F.when(((i + F.col("row_id")) % 7 > 0) & (F.col("row_id") % 11 > 0), x).otherwise(float("nan")))
    return named(df.select("row_id", holes.alias("w")), A.nan_stats(w))


@query(f"""WITH {SECONDS_SQL}, m AS (SELECT row_id, pos, CASE WHEN (pos + row_id) % 7 > 0 THEN v END AS v FROM s)
SELECT row_id, pos::INTEGER AS pos, {r6('coalesce(v, median(v) OVER (PARTITION BY row_id), 0)', 'v')} FROM m""")
def window_impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    holes = F.transform(w, lambda x, i: F.when((i + F.col("row_id")) % 7 > 0, x).otherwise(float("nan")))
    df = seconds(spark, sf_dir).select("row_id", A.impute_median(holes).alias("w"))
    return rounded(L.explode(df, "w", "v"), ["row_id", "pos"])


@query(f"""WITH {SECONDS_SQL}, m AS (SELECT row_id, avg(v) AS m, stddev_pop(v) AS s FROM s GROUP BY 1)
SELECT row_id, {r6('avg(((v - m) / (s + 1e-8::DOUBLE)) ^ 3)', 'skew')}, {r6('avg(((v - m) / (s + 1e-8::DOUBLE)) ^ 4) - 3', 'kurtosis')},
{r6('max(abs(v - m)) / (max(s) + 1e-6::DOUBLE)', 'crest')}, {r6('avg(CASE WHEN abs((v - m) / (s + 1e-6::DOUBLE)) > 3 THEN 1 ELSE 0 END)', 'spikes')}
FROM s JOIN m USING (row_id) GROUP BY row_id""")
def window_skew_kurt(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    z = A.zscore(w, 1e-6)
    return named(seconds(spark, sf_dir), {
        "skew": A.moment(w, 3, 1e-8), "kurtosis": A.moment(w, 4, 1e-8) - 3, "crest": F.array_max(F.transform(z, F.abs)),
        "spikes": A.mean(z, lambda x: F.when(F.abs(x) > 3, 1.0).otherwise(0.0)),
    })


@query(f"""WITH {SECONDS_SQL}, d AS (SELECT *, v - 2 * lag(v) OVER o + lag(v, 2) OVER o AS d2 FROM s WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
z AS (SELECT row_id, pos, CASE WHEN v - avg(v) OVER (PARTITION BY row_id) >= 0 THEN 1 ELSE -1 END AS sg FROM s),
c AS (SELECT row_id, sum(CASE WHEN sg <> p THEN 1 ELSE 0 END) AS n FROM (SELECT *, lag(sg) OVER (PARTITION BY row_id ORDER BY pos) AS p FROM z) GROUP BY 1)
SELECT row_id, {r6('avg(d2)', 'd2_mean')}, {r6('stddev_pop(d2)', 'd2_std')}, {r6('sum(d2 * d2)', 'd2_energy')}, {r6('max(n)', 'crossings')},
{r6('max(n) / 2 * 60 / (63 / 64::DOUBLE)', 'crossing_bpm')} FROM d JOIN c USING (row_id) GROUP BY row_id""")
def window_second_diff_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    d2 = A.diff(A.diff(w))
    return named(seconds(spark, sf_dir), {
        "d2_mean": A.mean(d2), "d2_std": A.std(d2), "d2_energy": A.energy(d2), "crossings": A.zero_crossings(w), "crossing_bpm": A.zero_crossing_bpm(w, RATE),
    })


@query(f"""WITH {WINDOWS_SQL}, b AS (SELECT row_id, pos // 64 AS b, avg(v) AS m, stddev_pop(v) AS s, sum(v * v) AS e FROM w GROUP BY 1, 2)
SELECT row_id, {r6('regr_slope(m, b)', 'mean_slope')}, {r6('regr_slope(s, b)', 'std_slope')}, {r6('regr_slope(e, b)', 'energy_slope')},
{r6('regr_slope(ln(e + 1e-6::DOUBLE), b)', 'exp_slope')}, {r6('regr_intercept(ln(e + 1e-6::DOUBLE), b)', 'exp_intercept')},
{r6('max_by(m, b) - min_by(m, b)', 'mean_contrast')}, {r6('max_by(s, b) - min_by(s, b)', 'std_contrast')},
{r6('stddev_pop(s)', 'envelope_std')}, {r6('max(s)', 'envelope_max')}, {r6('min(s)', 'envelope_min')} FROM b GROUP BY row_id""")
def block_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    blocks = A.block_summary(w, 10, 64)
    df = windows(spark, sf_dir).select("row_id", *[c.alias(k) for k, c in blocks.items()])
    m, s, logs = F.col("mean"), F.col("std"), F.transform("energy", lambda e: F.ln(e + 1e-6))
    ends = lambda c: F.element_at(c, -1) - F.get(c, F.lit(0))
    return named(df, {
        "mean_slope": A.slope(m), "std_slope": A.slope(s), "energy_slope": A.slope(F.col("energy")), "exp_slope": A.slope(logs), "exp_intercept": A.intercept(logs),
        "mean_contrast": ends(m), "std_contrast": ends(s), "envelope_std": A.std(s), "envelope_max": F.array_max(s), "envelope_min": F.array_min(s),
    })


LAGS_SQL = f"""{WINDOWS_SQL}, c AS (SELECT row_id, pos, v - avg(v) OVER (PARTITION BY row_id) AS x FROM w),
e AS (SELECT row_id, sum(x * x) + 1e-8::DOUBLE AS e FROM c GROUP BY 1),
r AS (SELECT a.row_id, b.pos - a.pos AS lag, sum(a.x * b.x) / max(e) AS c FROM c a JOIN c b ON a.row_id = b.row_id AND b.pos - a.pos BETWEEN 19 AND 288
      JOIN e ON e.row_id = a.row_id GROUP BY 1, 2)"""


@query(f"""WITH {LAGS_SQL} SELECT row_id, {r6('60 * 64::DOUBLE / max_by(lag, struct_pack(c := c, l := -lag))', 'bpm')}, {r6('max(c)', 'peak')}
FROM r WHERE lag <= 96 GROUP BY row_id""")
def autocorr_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return named(windows(spark, sf_dir), A.autocorr_bpm(w, RATE))


@query(f"""WITH {LAGS_SQL}, b AS (SELECT row_id, max_by(lag, struct_pack(c := c, l := -lag)) AS l1, max(c) AS c1 FROM r WHERE lag <= 96 GROUP BY 1),
o AS (SELECT r.row_id, max_by(lag, struct_pack(c := c, l := -lag)) AS l2, max(c) AS c2 FROM r JOIN b USING (row_id) WHERE lag <= 96 AND abs(lag - l1) > 3 GROUP BY 1),
h AS (SELECT x.row_id, x.lag, (x.c + y.c + z.c) / 3 AS c FROM r x JOIN r y ON y.row_id = x.row_id AND y.lag = 2 * x.lag JOIN r z ON z.row_id = x.row_id AND z.lag = 3 * x.lag WHERE x.lag <= 96),
g AS (SELECT row_id, max_by(lag, struct_pack(c := c, l := -lag)) AS l3, max(c) AS c3 FROM h GROUP BY 1)
SELECT row_id, {r6('3840 / l1', 'bpm1')}, {r6('c1', 'c1')}, {r6('3840 / l2', 'bpm2')}, {r6('c2', 'c2')}, {r6('c2 / (abs(c1) + 1e-8::DOUBLE)', 'ratio')},
{r6('3840 / l3', 'harmonic_bpm')}, {r6('c3', 'harmonic_score')} FROM b JOIN o USING (row_id) JOIN g USING (row_id)""")
def harmonic_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    found = windows(spark, sf_dir).select("row_id", A.harmonic_bank(w, RATE).alias("bank"))
    return rounded(found.select("row_id", "bank.*"), ["row_id"])


@query(f"""WITH {WINDOWS_SQL}, k AS (SELECT unnest(generate_series(0, 568, 8)) AS o),
p AS (SELECT a.row_id, o, a.v AS x, b.v AS y FROM w a JOIN k ON a.pos BETWEEN o AND o + 63 JOIN w b ON b.row_id = a.row_id AND b.pos = a.pos - o + 576),
q AS (SELECT row_id, o, covar_pop(x, y) * 64 AS c, var_pop(x) * 64 AS e, var_pop(y) * 64 AS f FROM p GROUP BY 1, 2)
SELECT row_id, (o // 8)::INTEGER AS pos, {r6('c / sqrt(e * f + 1e-8::DOUBLE)', 'c')} FROM q""")
def sliding_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    found = windows(spark, sf_dir).select("row_id", A.sliding_correlation(w, 64, 8).alias("c"))
    return rounded(L.explode(found, "c", "c"), ["row_id", "pos"])


NEIGHBOURS = f"{WINDOWS_SQL}, n AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM w WINDOW o AS (PARTITION BY row_id ORDER BY pos))"


@query(f"""WITH {NEIGHBOURS}, p AS (SELECT row_id, (pos - lag(pos) OVER (PARTITION BY row_id ORDER BY pos)) / 64::DOUBLE AS g FROM n WHERE v > a AND v > b)
SELECT row_id, {r6('count(*)', 'count')}, {r6('avg(g)', 'mean_interval')}, {r6('stddev_pop(g)', 'std_interval')},
{r6('stddev_pop(g) / (avg(g) + 1e-8::DOUBLE)', 'cv_interval')}, {r6('60 / (avg(g) + 1e-8::DOUBLE)', 'bpm')} FROM p GROUP BY row_id""")
def peak_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return named(windows(spark, sf_dir), A.peak_intervals(w, RATE))


def peaks_sql(samples: str, tag: str = "") -> str:
    """Tables that end in one, p{tag}, of the morphology of the windows whose samples (row_id, pos, v) are in the table samples."""
    return f"""n{tag} AS (SELECT *, lag(v) OVER o AS a, lead(v) OVER o AS b FROM {samples} WINDOW o AS (PARTITION BY row_id ORDER BY pos)),
m{tag} AS (SELECT *, v > a AND v > b AS peak, v < a AND v < b AS trough FROM n{tag}),
f{tag} AS (SELECT *, max(CASE WHEN trough THEN pos END) OVER (PARTITION BY row_id ORDER BY pos) AS prev,
  min(CASE WHEN trough THEN pos END) OVER (PARTITION BY row_id ORDER BY pos DESC) AS next,
  lag(CASE WHEN peak THEN pos END IGNORE NULLS) OVER (PARTITION BY row_id ORDER BY pos) AS before FROM m{tag}),
j{tag} AS (SELECT f.row_id, f.v - coalesce(x.v, y.v) AS amp, (f.pos - prev) / 64::DOUBLE AS rise, (next - f.pos) / 64::DOUBLE AS fall, (f.pos - before) / 64::DOUBLE AS gap
  FROM f{tag} f LEFT JOIN {samples} x ON x.row_id = f.row_id AND x.pos = prev LEFT JOIN {samples} y ON y.row_id = f.row_id AND y.pos = next WHERE peak),
t{tag} AS (SELECT row_id, count(*) AS n FROM m{tag} WHERE trough GROUP BY 1),
p{tag} AS (SELECT row_id, {r6('count(*)', 'peaks')}, {r6('max(n)', 'troughs')}, {r6('avg(amp)', 'amp_mean')}, {r6('stddev_pop(amp)', 'amp_std')}, {r6('avg(rise)', 'rise_mean')},
{r6('stddev_pop(rise)', 'rise_std')}, {r6('avg(fall)', 'fall_mean')}, {r6('stddev_pop(fall)', 'fall_std')}, {r6('avg(rise) / (avg(fall) + 1e-8::DOUBLE)', 'rise_fall')},
{r6('avg(gap)', 'gap_mean')}, {r6('stddev_pop(gap)', 'gap_std')}, {r6('stddev_pop(gap) / (avg(gap) + 1e-8::DOUBLE)', 'gap_cv')}, {r6('60 / (avg(gap) + 1e-8::DOUBLE)', 'bpm', 9)}
FROM j{tag} JOIN t{tag} USING (row_id) GROUP BY row_id)"""


RECENT_SQL = "recent AS (SELECT row_id, pos - 448 AS pos, v FROM w WHERE pos >= 448)"


@query(f"WITH {WINDOWS_SQL}, {peaks_sql('w')} SELECT * REPLACE ({r6('bpm', 'bpm')}) FROM p")
def peak_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(L.peak_morphology(windows(spark, sf_dir), RATE), ["row_id"])


@query(f"WITH {WINDOWS_SQL}, {RECENT_SQL}, {peaks_sql('recent')} SELECT * REPLACE ({r6('bpm', 'bpm')}) FROM p")
def recent_morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks and troughs of the last three seconds."""
    recent = windows(spark, sf_dir).select("row_id", F.slice("w", 449, 192).alias("w"))
    return rounded(L.peak_morphology(recent, RATE), ["row_id"])


@query(f"""WITH {LAGS_SQL}, {RECENT_SQL}, {peaks_sql('w', '1')}, {peaks_sql('recent', '2')},
z AS (SELECT row_id, count(*) FILTER (WHERE (x < 0) <> (y < 0)) * 30 / (639 / 64::DOUBLE) AS zero FROM (SELECT row_id, x, lag(x) OVER (PARTITION BY row_id ORDER BY pos) AS y FROM c) GROUP BY 1),
h AS (SELECT x.row_id, x.lag, (x.c + y.c + z.c) / 3 AS c FROM r x JOIN r y ON y.row_id = x.row_id AND y.lag = 2 * x.lag JOIN r z ON z.row_id = x.row_id AND z.lag = 3 * x.lag WHERE x.lag <= 96),
g AS (SELECT row_id, 3840.0::DOUBLE / max_by(lag, struct_pack(c := c, l := -lag)) AS harmonic FROM h GROUP BY 1),
a AS (SELECT row_id, p1.bpm AS whole, zero, harmonic, p2.bpm AS recent FROM p1 JOIN p2 USING (row_id) JOIN z USING (row_id) JOIN g USING (row_id)),
u AS (SELECT row_id, unnest([whole, zero, harmonic, recent]) AS v FROM a),
q AS (SELECT row_id, avg(v) AS m, median(v) AS d, stddev_pop(v) AS s, max(v) - min(v) AS g FROM u GROUP BY 1)
SELECT row_id, {r6('m', 'bpm_mean')}, {r6('d', 'bpm_median')}, {r6('s', 'bpm_std')}, {r6('g', 'bpm_range')}, {r6('harmonic / (whole + 1e-8::DOUBLE)', 'harmonic_over_peak')},
{r6('recent - whole', 'recent_less_whole')} FROM q JOIN a USING (row_id)""")
def bpm_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far four estimates of the rate agree: by peaks, by zero crossings, by the harmonics of the autocorrelation, and by
    the peaks of the last three seconds."""
    w = windows(spark, sf_dir)
    recent = w.select("row_id", F.slice("w", 449, 192).alias("w"))
    own = w.select("row_id", A.zero_crossing_bpm(F.col("w"), RATE).alias("zero"), A.harmonic_bank(F.col("w"), RATE)["harmonic_bpm"].alias("harmonic"))
    peak = lambda rows, name: L.peak_morphology(rows, RATE).select("row_id", F.round("bpm", 9).alias(name))
    found = peak(w, "whole").join(peak(recent, "recent"), "row_id").join(own, "row_id")
    e = F.array("whole", "zero", "harmonic", "recent")
    return named(found, {
        "bpm_mean": A.mean(e), "bpm_median": A.quantile(e, 0.5), "bpm_std": A.std(e), "bpm_range": F.array_max(e) - F.array_min(e),
        "harmonic_over_peak": F.col("harmonic") / (F.col("whole") + 1e-8), "recent_less_whole": F.col("recent") - F.col("whole"),
    })


@query(f"""WITH {SECONDS_SQL}, p AS (SELECT a.row_id, a.pos, avg(b.v) AS x FROM s a, range(0, 5) k(k) JOIN s b ON b.row_id = a.row_id AND b.pos = greatest(0, least(63, a.pos - 2 + k)) GROUP BY 1, 2),
q AS (SELECT a.row_id, a.pos, avg(b.v) AS y FROM s a, range(0, 61) k(k) JOIN s b ON b.row_id = a.row_id AND b.pos = greatest(0, least(63, a.pos - 30 + k)) GROUP BY 1, 2)
SELECT row_id, pos::INTEGER AS pos, {r6('x - y', 'v')} FROM p JOIN q USING (row_id, pos)""")
def moving_average_bandpass(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    found = seconds(spark, sf_dir).select("row_id", A.band_pass(w, 5, 61).alias("w"))
    return rounded(L.explode(found, "w", "v"), ["row_id", "pos"])


@query(f"""WITH {SECONDS_SQL}, t AS (SELECT *, avg(v) OVER (PARTITION BY row_id ORDER BY pos ROWS 3 PRECEDING) AS t FROM s)
SELECT row_id, {r6('regr_slope(t, pos)', 'tonic_slope')}, {r6('stddev_pop(v - t)', 'phasic_std')}, {r6('max(v - t) - min(v - t)', 'phasic_range')} FROM t GROUP BY row_id""")
def trailing_tonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = L.explode(seconds(spark, sf_dir), "w", "v")
    df = df.withColumn("t", F.avg("v").over(W.partitionBy("row_id").orderBy("pos").rowsBetween(-3, 0)))
    phasic = F.col("v") - F.col("t")
    return rounded(df.groupBy("row_id").agg(
        F.regr_slope("t", "pos").alias("tonic_slope"), F.stddev_pop(phasic).alias("phasic_std"), (F.max(phasic) - F.min(phasic)).alias("phasic_range")
    ), ["row_id"])


@query("""WITH RECURSIVE o AS (SELECT user_id, value::DOUBLE AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
f AS (SELECT user_id, k, x, x AS level, 0::DOUBLE AS var FROM o WHERE k = 1
  UNION ALL SELECT o.user_id, o.k, o.x, a * f.level + (1 - a) * o.x, a * f.var + (1 - a) * (o.x - (a * f.level + (1 - a) * o.x)) ^ 2
  FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1, (SELECT 0.5::DOUBLE ^ (1 / 8::DOUBLE) AS a))
SELECT user_id, """ + ", ".join([r6("max_by(level, k)", "level"), r6("sqrt(max_by(var, k) + 1e-12::DOUBLE)", "std"), r6("max_by(level, k) - avg(x)", "momentum")]) + " FROM f GROUP BY user_id")
def ewma_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subject's series, however long: a parallel scan of maps."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return rounded(ewma(events, "user_id", "ts", "event_id", "value", 8).drop("n"), ["user_id"])


EWMA_SQL = ORACLE_SQL["ewma_recency"].split("SELECT user_id, round")[0]


@query(EWMA_SQL + f"SELECT event_id, k AS place, {r6('level', 'level')}, {r6('var', 'var')} FROM (SELECT f.*, event_id FROM f JOIN (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) USING (user_id, k))")
def ewma_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and variance after every event of a subject."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    found = ewma_filled(events, "user_id", "ts", "event_id", "value", 8)
    return rounded(found.select("event_id", F.col("_place").cast("long").alias("place"), F.col("_level").alias("level"), F.col("_var").alias("var")), ["event_id", "place"])


@query(f"""WITH {SECONDS_SQL}, t AS (SELECT row_id, v, 2 * pos / 63::DOUBLE - 1 AS t FROM s),
m AS (SELECT row_id, sum(v) AS y0, sum(v * t) AS y1, sum(v * t * t) AS y2, sum(v * t * t * t) AS y3, count(*) AS n, sum(t ^ 2) AS s2, sum(t ^ 4) AS s4, sum(t ^ 6) AS s6 FROM t GROUP BY 1)
SELECT row_id, {r6('(y1 * s6 - y3 * s4) / (s2 * s6 - s4 * s4)', 'c1')}, {r6('(n * y2 - s2 * y0) / (n * s4 - s2 * s2)', 'c2')}, {r6('(y3 * s2 - y1 * s4) / (s2 * s6 - s4 * s4)', 'c3')} FROM m""")
def poly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    return named(seconds(spark, sf_dir), {f"c{k + 1}": c for k, c in enumerate(A.poly_trend(w, 64))})


@query(f"""WITH {WINDOWS_SQL}, i AS (SELECT unnest(range(0, 320)) AS i),
m AS (SELECT x.row_id, i, x.v AS x, y.v AS y, z.v AS z FROM i JOIN w x ON x.pos = i JOIN w y ON y.row_id = x.row_id AND y.pos = i + 320 JOIN w z ON z.row_id = x.row_id AND z.pos = 2 * i),
d AS (SELECT *, 32 * sqrt((x - lag(x) OVER o) ^ 2 + (y - lag(y) OVER o) ^ 2 + (z - lag(z) OVER o) ^ 2) AS j, sqrt(x * x + y * y + z * z) AS mag FROM m WINDOW o AS (PARTITION BY row_id ORDER BY i)),
b AS (SELECT row_id, pos // 64 AS b, stddev_pop(v) AS p FROM w GROUP BY 1, 2), c AS (SELECT row_id, i // 32 AS b, stddev_pop(mag) AS q FROM d GROUP BY 1, 2),
r AS (SELECT row_id, covar_pop(p, q) / ((stddev_pop(p) + 1e-8::DOUBLE) * (stddev_pop(q) + 1e-8::DOUBLE)) AS r FROM b JOIN c USING (row_id, b) GROUP BY 1),
e AS (SELECT row_id, sum(v * v) AS e FROM w GROUP BY 1)
SELECT row_id, {r6('avg(x * y)', 'xy')}, {r6('avg(x * z)', 'xz')}, {r6('avg(y * z)', 'yz')}, {r6('avg(abs(x) + abs(y) + abs(z))', 'sma')}, {r6('avg(j)', 'jerk_mean')},
{r6('stddev_pop(j)', 'jerk_std')}, {r6('sum(j * j)', 'jerk_energy', 4)}, {r6('max(e) / (sum(mag * mag) + 1e-6::DOUBLE)', 'ratio')}, {r6('ln(1 + max(e) / (sum(mag * mag) + 1e-6::DOUBLE))', 'log_ratio')},
{r6('max(r)', 'block_corr')} FROM d JOIN r USING (row_id) JOIN e USING (row_id) GROUP BY row_id""")
def motion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z, bvp = F.col("acc_x"), F.col("acc_y"), F.col("acc_z"), F.col("bvp")
    df = channels(spark, sf_dir).withColumn("mag", A.magnitude(x, y, z))
    ratio = A.energy(bvp) / (A.energy(F.col("mag")) + 1e-6)
    jerk = A.jerk(x, y, z, 32)
    pulse, motion = A.block_summary(bvp, 10, 64)["std"], A.block_summary(F.col("mag"), 10, 32)["std"]
    out = df.select("row_id", *[c.alias(k) for k, c in A.axis_interactions(x, y, z).items()], A.signal_magnitude_area(x, y, z).alias("sma"),
                    *[c.alias(f"jerk_{k}") for k, c in jerk.items()], ratio.alias("ratio"), F.log1p(ratio).alias("log_ratio"),
                    pulse.alias("p"), motion.alias("q"))
    out = out.withColumn("block_corr", A.correlation(F.col("p"), F.col("q"))).drop("p", "q").withColumn("jerk_energy", F.round("jerk_energy", 4))
    return rounded(out, ["row_id"])


@query(f"""WITH {SECONDS_SQL}, h AS (SELECT row_id, pos, (v - avg(v) OVER (PARTITION BY row_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 63)) AS x FROM s),
k AS (SELECT unnest(range(0, 36)) AS k), p AS (SELECT row_id, k, sum(x * cos(2 * pi() * (36 + 5 * k) / 60 * pos / 64)) ^ 2 + sum(x * sin(2 * pi() * (36 + 5 * k) / 60 * pos / 64)) ^ 2 AS p FROM h, k GROUP BY 1, 2)
SELECT row_id, k::INTEGER AS k, {r6('p', 'power')}, {r6('p / (sum(p) OVER (PARTITION BY row_id) + 1e-20::DOUBLE)', 'share')} FROM p""")
def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.periodogram(seconds(spark, sf_dir), [36 + 5 * k for k in range(36)], RATE)
    total = F.sum("power").over(W.partitionBy("row_id"))
    return rounded(found.withColumn("share", F.col("power") / (total + 1e-20)), ["row_id", "k"])


SOFT = f"{SECONDS_SQL}, e AS (SELECT row_id, pos, v, exp(v - max(v) OVER (PARTITION BY row_id)) AS e FROM s), p AS (SELECT *, e / sum(e) OVER (PARTITION BY row_id) AS p FROM e), c AS (SELECT *, sum(p) OVER (PARTITION BY row_id ORDER BY pos) AS c FROM p)"


@query(f"""WITH {SOFT}, k AS (SELECT row_id, max_by(pos, struct_pack(v := v, l := -pos)) AS k FROM s GROUP BY 1),
t AS (SELECT row_id, greatest(1, least(62, k)) AS k FROM k), n AS (SELECT t.row_id, t.k, max(v) FILTER (WHERE pos = t.k - 1) AS a, max(v) FILTER (WHERE pos = t.k) AS b, max(v) FILTER (WHERE pos = t.k + 1) AS c FROM t JOIN s USING (row_id) GROUP BY 1, 2),
j AS (SELECT s.row_id, max_by(pos, struct_pack(v := v, l := -pos)) AS j, max(v) AS v2 FROM s JOIN k USING (row_id) WHERE abs(pos - k) > 10 GROUP BY 1)
SELECT row_id, {r6('min(n.k) + greatest(-1, least(1, CASE WHEN abs(min(a - 2 * b + n.c)) > 1e-12 THEN 0.5::DOUBLE * min(a - n.c) / min(a - 2 * b + n.c) ELSE 0 END))', 'peak')},
{r6('min(j)', 'second')}, {r6('max(p.v) - min(v2)', 'margin')}, {r6('sum(p * pos)', 'centroid')}, {r6('sqrt(greatest(sum(p * pos * pos) - sum(p * pos) ^ 2, 0))', 'spread')},
{r6('-sum(p * ln(p + 1e-12::DOUBLE))', 'entropy')}, {r6('min(pos) FILTER (WHERE p.c >= 0.25)', 'q25')}, {r6('min(pos) FILTER (WHERE p.c >= 0.5)', 'median')}, {r6('min(pos) FILTER (WHERE p.c >= 0.75)', 'q75')}
FROM c p JOIN n USING (row_id) JOIN j USING (row_id) GROUP BY row_id""")
def surface_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each vector taken as a score over 64 candidates."""
    w = F.col("w")
    df = seconds(spark, sf_dir).select("row_id", "w", A.softmax(w).alias("p"))
    p = F.col("p")
    at = lambda power: A.total(F.transform(p, lambda x, i: x * F.pow(i.cast("double"), F.lit(float(power)))))
    one, two = A.strongest(w, 2, 10)
    return named(df, {
        "peak": A.parabolic_peak(w, 0.0, 1.0), "second": two.cast("double"), "margin": F.get(w, one) - F.get(w, two), "centroid": at(1),
        "spread": F.sqrt(F.greatest(at(2) - at(1) * at(1), F.lit(0.0))), "entropy": -A.total(p, lambda x: x * F.ln(x + 1e-12)),
        "q25": A.cumulative_index(p, 0.25).cast("double"), "median": A.cumulative_index(p, 0.5).cast("double"), "q75": A.cumulative_index(p, 0.75).cast("double"),
    })


@query(f"""WITH {SECONDS_SQL}, b AS (SELECT row_id, pos // 4 AS b, sum(v) AS v FROM s GROUP BY 1, 2), x AS (SELECT row_id, b, least(2.0::DOUBLE * b * 4, 62.999::DOUBLE) AS k, v FROM b)
SELECT x.row_id, b::INTEGER AS pos, {r6('x.v', 'v')}, {r6('l.v * (1 - (k - floor(k))) + h.v * (k - floor(k))', 'doubled')} FROM x JOIN s l ON l.row_id = x.row_id AND l.pos = floor(k) JOIN s h ON h.row_id = x.row_id AND h.pos = floor(k) + 1""")
def coarsen_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of four candidates, and the surface at twice each group's first one."""
    w = F.col("w")
    doubled = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: A.interpolate_at(w, 2.0 * b * 4))
    both = F.arrays_zip(A.coarsen(w, 4).alias("v"), doubled.alias("doubled"))
    return rounded(seconds(spark, sf_dir).select("row_id", F.posexplode(both).alias("pos", "x")).select("row_id", "pos", "x.*"), ["row_id", "pos"])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised square, gate and safe log of each sample."""
    w = F.col("w")
    parts = F.arrays_zip(A.normalised_square(w).alias("square"), F.transform(w, lambda x: A.gate(x, 0.1)).alias("gated"), F.transform(w, A.log_safe).alias("log_safe"))
    return seconds(spark, sf_dir).select("row_id", F.posexplode(parts).alias("pos", "x")).select("row_id", "pos", "x.*")


@query(f"""WITH {SECONDS_SQL}, q AS (SELECT row_id, avg(v * v) AS q FROM s GROUP BY 1)
SELECT row_id, pos::INTEGER AS pos, {r6('v * v / q', 'square')}, {r6('v * (1 + 0.6::DOUBLE * tanh(12 * (abs(v) - 0.1::DOUBLE)))', 'gated')}, {r6('ln(greatest(v, 1e-12::DOUBLE))', 'log_safe')} FROM s JOIN q USING (row_id)""")
def sample_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(samples(spark, sf_dir), ["row_id", "pos"])


@query(f"""WITH {WINDOWS_SQL}, g AS (SELECT vec_id // 10 AS row_id, avg(label) AS target FROM embeddings GROUP BY 1),
q AS (SELECT row_id, stddev_pop(v) AS std, max(abs(v - m)) / (stddev_pop(v) + 1e-9::DOUBLE) AS most, min(CASE WHEN pos % 16 = 0 THEN abs(v) END) AS skin
  FROM (SELECT *, avg(v) OVER (PARTITION BY row_id) AS m FROM w) GROUP BY 1),
k AS (SELECT * FROM q JOIN g USING (row_id) WHERE std > (SELECT quantile_cont(std, 0.25) FROM q) AND most < 5 AND skin > 1e-6)
SELECT row_id, {r6('target', 'target')}, {r6('abs(target - (SELECT median(target) FROM k))', 'distance')}, {r6('std', 'std')} FROM k
ORDER BY abs(target - (SELECT median(target) FROM k)), row_id LIMIT 1""")
def representative_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the windows of good quality (a pulse above the lower quartile of deviations, without spikes of five deviations, and
    a skin signal) the one whose target is nearest their median; the target is the mean label of its vectors."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.floor(F.col("vec_id") / 10).alias("row_id")).agg(F.avg("label").alias("target"))
    w = F.col("w")
    spread = A.let(A.mean(w), lambda m: A.let(A.std(w) + 1e-9, lambda s: F.array_max(F.transform(w, lambda x: F.abs(x - m) / s))))
    rows = windows(spark, sf_dir).select("row_id", A.std(w).alias("std"), spread.alias("most"), F.array_min(F.transform(A.every(w, 16), lambda x: F.abs(x))).alias("skin"))
    rows = durable(rows.join(e, "row_id"))
    low = exact_quantiles(rows, {"std": F.col("std")}, [0.25])["std"][0]
    fine = rows.where((F.col("std") > low) & (F.col("most") < 5) & (F.col("skin") > 1e-6))
    near = fine.withColumn("distance", F.abs(F.col("target") - F.lit(median(fine, F.col("target")))))
    return rounded(near.orderBy("distance", "row_id").limit(1).select("row_id", "target", "distance", "std"), ["row_id"])


@query(f"""WITH {WINDOWS_SQL}, k AS (SELECT unnest(range(0, 8)) AS k)
SELECT row_id, k::INTEGER AS k, {r6('avg(v)', 'mean')}, {r6('stddev_pop(v)', 'std')}, {r6('sum(v * v)', 'energy')} FROM w JOIN k ON pos BETWEEN 64 * k AND 64 * k + 191 GROUP BY 1, 2""")
def sub_window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-second stretches of each window, a second apart, by a table function in SQL."""
    tables.register(spark)
    stats = "transform(part, x -> named_struct('v', x))"
    found = spark.sql(f"""SELECT row_id, k, avg(v) AS mean, stddev_pop(v) AS std, sum(v * v) AS energy FROM (
        SELECT row_id, k, inline({stats}) FROM {{w}}, LATERAL sub_windows(w, 192, 64) WHERE k < 8) GROUP BY row_id, k""", w=windows(spark, sf_dir))
    return rounded(found, ["row_id", "k"])


@query(f"""WITH {SECONDS_SQL}, h AS (SELECT row_id, pos, (v - avg(v) OVER (PARTITION BY row_id)) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 63)) AS x FROM s),
k AS (SELECT 40 + 10 * unnest(range(0, 18)) AS bpm), p AS (SELECT row_id, bpm, sum(x * cos(2 * pi() * bpm / 60 * pos / 64)) ^ 2 + sum(x * sin(2 * pi() * bpm / 60 * pos / 64)) ^ 2 AS p FROM h, k GROUP BY 1, 2),
q AS (SELECT *, p / (sum(p) OVER (PARTITION BY row_id) + 1e-20::DOUBLE) AS share FROM p)
SELECT row_id, {r6('bpm', 'bpm')}, {r6('p', 'power')}, {r6('share', 'share')} FROM q""")
def evidence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The power of each second's samples at 18 candidate rates, by a table function in SQL."""
    tables.register(spark)
    found = spark.sql("SELECT row_id, bpm, power, share FROM {w}, LATERAL evidence(w, 64.0D, 40.0D, 210.0D, 10.0D)", w=seconds(spark, sf_dir))
    return rounded(found, ["row_id"])
