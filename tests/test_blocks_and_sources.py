"""Block filters, archives read in parts, unions of sources, permuted folds, fitted powers and table functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_tasks import equals_its_sql
from wavespark.functions import physio as P
from wavespark.functions import tables
from wavespark.operators import joins as J
from wavespark.operators import splits, transforms
from wavespark.plans import queries, source_queries, tasks
from wavespark.sources import subjects as sub

R = np.random.default_rng(21)


# ------------------------------------------------------------------ filters


def sample_by_sample(x, rate, low, high, order):
    """The zero-phase filter, section after section and sample after sample, in long doubles."""
    nyquist, wide = rate / 2, np.longdouble
    parts = [(b.astype(wide), a.astype(wide)) for b, a in P.sections(order, low and low / nyquist, high and min(high / nyquist, 0.99))]
    pad = min(3 * (sum(len(a) - 1 for _, a in parts) + 1), len(x) - 1)
    w = x.astype(wide)
    w = np.concatenate([2 * w[0] - w[pad:0:-1], w, 2 * w[-1] - w[-2 : -pad - 2 : -1]])
    for _ in range(2):
        level = w[0]
        for b, a in parts:
            gain, n = b.sum() / a.sum(), len(a) - 1
            state = [level * sum(b[k:] - a[k:] * gain) for k in range(1, n + 1)]
            out = []
            for v in w:
                y = b[0] * v + state[0]
                state = [(state[k + 1] if k + 1 < n else 0) + b[k + 1] * v - a[k + 1] * y for k in range(n)]
                out.append(y)
            w, level = np.array(out), level * gain
        w = w[::-1]
    return w[pad : len(w) - pad].astype(float)


@pytest.mark.parametrize("args", [(64, 0.7, 3.5, 3), (250, 5.0, 25.0, 3), (25, 0.08, 0.8, 3), (4, None, 0.05, 2), (250, 0.05, None, 4), (64, None, 8.0, 3)])
@pytest.mark.parametrize("n", [2, 30, 256, 1100])
def test_block_filter_is_the_recurrence(args, n):
    x = R.normal(size=(3, n)).cumsum(axis=1) * 0.05 + 3
    got = P.zero_phase(x, args[0], *args[1:])
    assert np.abs(got[1] - sample_by_sample(x[1], *args)).max() < 1e-9


@pytest.mark.parametrize("edges", [(0.02, 0.1), (None, 0.3), (0.2, None)])
@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_sections_are_the_polynomials(order, edges):
    b, a = np.ones(1), np.ones(1)
    for u, v in P.sections(order, *edges):
        b, a = np.convolve(b, u), np.convolve(a, v)
    want_b, want_a = P.butterworth(order, *edges)
    assert np.allclose(np.pad(b, (0, len(want_b) - len(b))), want_b, atol=1e-12) and np.allclose(a, want_a)


# ------------------------------------------------------------------ archives


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_archives_are_read_in_parts(spark, tmp_path, save):
    hr, acc = R.normal(size=(23, 300)).astype("f4"), R.normal(size=(23, 9600, 3))
    save(tmp_path / "one.npz", e4_hr=hr, e4_acc=acc, glucose=np.arange(23.0), subject_id=np.array(["a", "bé"] * 11 + ["c"]), timestamp=np.arange(23) * 300)
    save(tmp_path / "two.npz", e4_eda=np.zeros((2, 1200)))
    (tmp_path / "other.txt").write_text("no archive")
    rows = sub.read_archives(spark, str(tmp_path), rows=3, rows_per_task=5)
    assert rows.rdd.getNumPartitions() == 6
    found = {(r["subject_id"], r["ts"]): r for r in rows.collect()}
    assert len(found) == 25
    for k in range(23):
        r = found[["a", "bé"][k % 2] if k < 22 else "c", 300.0 * k]
        assert np.array_equal(r["e4_hr"], hr[k]) and np.array_equal(np.float32(r["e4_acc"]), acc[k].astype("f4").ravel())
        assert r["glucose"] == k and r["e4_eda"] is None
    assert found[str(tmp_path / "two.npz"), 1.0]["e4_hr"] is None and np.isnan(found[str(tmp_path / "two.npz"), 1.0]["glucose"])
    assert sub.read_archives(spark, f"file://{tmp_path}/one.npz", rows_per_task=100).count() == 23


def test_archives_that_cannot_be_read(spark, tmp_path):
    np.savez(tmp_path / "x.npz", other=np.zeros(3))
    with pytest.raises(Exception, match="number of windows"):
        sub.read_archives(spark, str(tmp_path)).count()
    np.savez(tmp_path / "x.npz", glucose=np.array([None, 1], dtype=object))
    with pytest.raises(Exception, match="plain arrays"):
        sub.read_archives(spark, str(tmp_path)).count()
    (tmp_path / "none").mkdir()
    assert sub.read_archives(spark, str(tmp_path / "none")).count() == 0


# ------------------------------------------------------------------ sources


def test_union_keeps_what_all_sources_have(spark):
    names = [f"c{k}" for k in range(130)]
    lacks = {0: {"c0", "c61"}, 1: {"c62"}, 2: {"c129", "c0"}}
    rows = [(s, *[None if c in lacks[s] or (k % 3 == 0 and c == "c7") else float(k) for c in names]) for k in range(30) for s in range(3)]
    df = spark.createDataFrame(rows, "s int, " + ", ".join(f"{c} double" for c in names)).repartition(7)
    want = [c for c in names if c not in {"c0", "c61", "c62", "c129"}]
    assert J.common_columns(df, "s", names) == want and J.common_columns(df, "s", []) == []
    assert J.union_of_sources(df, F.col("s") % 1, ["s"], names).columns == ["s", *names]
    assert J.common_columns(df.where("false"), "s", names) == []


def test_union_of_files_is_one_scan(spark, tmp_path):
    for k in range(12):
        df = spark.range(5).withColumn("a", F.lit(float(k))).withColumn("b", F.lit(1.0))
        (df.drop("b") if k == 7 else df).write.parquet(f"{tmp_path}/subject={k}")
    rows = spark.read.option("mergeSchema", "true").parquet(str(tmp_path))
    assert J.union_of_sources(rows, "subject", ["id"], ["a", "b"]).columns == ["id", "a"]
    found = tasks.load_feature_folder(spark, str(tmp_path), ("id", "subject"))
    assert found.columns == ["id", "subject", "a"] and found.count() == 60


# ------------------------------------------------------------------ folds


@pytest.mark.parametrize("n", [1, 2, 5, 64, 1000, 4097])
def test_permutation_is_one(n):
    found = splits.permutation(np.arange(n), n, 3)
    assert sorted(found.tolist()) == list(range(n))
    if n > 900:
        assert (found != splits.permutation(np.arange(n), n, 4)).any() and abs(np.corrcoef(np.arange(n), found)[0, 1]) < 0.1


@pytest.mark.parametrize("n,folds", [(23, 5), (3, 5), (1000, 7)])
def test_permuted_folds_are_equal_and_the_same_however_rows_are_dealt(spark, n, folds):
    a = {r["row_id"]: r["fold"] for r in splits.permuted(spark.range(n).withColumnRenamed("id", "row_id"), n, folds, 9).collect()}
    b = {r["row_id"]: r["fold"] for r in splits.permuted(spark.range(-4, n + 3).withColumnRenamed("id", "row_id").repartition(7), n, folds, 9).collect()}
    sizes = np.bincount(list(a.values()), minlength=folds)
    assert a == b and len(a) == n and sizes.max() - sizes.min() <= 1


def test_legacy_folds_are_numpys(spark):
    order = np.random.RandomState(5).permutation(53)
    want = {int(r): k for k, part in enumerate(np.array_split(order, 5)) for r in part}
    rows = spark.range(60).withColumnRenamed("id", "row_id").repartition(3)
    assert {r["row_id"]: r["fold"] for r in splits.shuffled(rows, 53, 5, 5).collect()} == want


# ------------------------------------------------------------------ powers


def likelihood(v, lam):
    u, w = np.log1p(v[v >= 0]), np.log1p(-v[v < 0])
    up = u if lam == 0 else np.expm1(lam * u) / lam
    down = -w if lam == 2 else -np.expm1((2 - lam) * w) / (2 - lam)
    return -np.log(np.concatenate([up, down]).var()) / 2 + (lam - 1) * (u.sum() - w.sum()) / len(v)


@pytest.mark.parametrize("lam", [-3.0, -1e-9, 0.0, 0.3, 1.0, 2.0, 2.0000001, 5.0])
def test_slopes_of_the_likelihood(spark, lam):
    v = R.normal(size=200) * 2 + 0.5
    rows = spark.createDataFrame([(float(x),) for x in [*v, np.nan, np.inf]], "v double").repartition(3)
    slope, bend = transforms.power_slopes(rows, {"v": lam})["v"]
    h = 1e-4
    at = [likelihood(v, lam + k * h) for k in (-1, 0, 1)]
    assert np.isclose(slope, (at[2] - at[0]) / (2 * h), atol=1e-5) and np.isclose(bend, (at[2] - 2 * at[1] + at[0]) / h**2, atol=1e-4, rtol=1e-3)


def test_powers_are_found_wherever_they_are(spark):
    n = 400
    columns = {"wide": np.exp(R.normal(size=n)) - 0.2, "far": 1e-3 * R.gamma(2, size=n) ** 2, "left": -np.exp(2 * R.normal(size=n)), "large": 1e4 + R.normal(size=n), "one": np.full(n, 7.0)}
    rows = spark.createDataFrame(list(zip(*(v.tolist() for v in columns.values()), strict=True)), ", ".join(f"{c} double" for c in columns))
    found = transforms.fit_yeo_johnson(rows, list(columns))
    slopes = transforms.power_slopes(rows, found)
    assert found["one"] == 1.0 and not -4 < found["far"] < 6
    for c in ("wide", "far", "left"):
        assert abs(slopes[c][0]) < 1e-8 and slopes[c][1] < 0
        assert likelihood(columns[c], found[c]) >= max(likelihood(columns[c], found[c] + d) for d in (-0.01, 0.01))


# ------------------------------------------------------------------ table functions


def test_table_functions_in_sql(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, [float(k) for k in range(10)]), (2, [1.0, 2.0]), (3, None)], "id int, w array<double>")
    found = spark.sql("SELECT id, k, start, part FROM {r}, LATERAL sub_windows(w, 4, 3)", r=rows).orderBy("id", "k").collect()
    assert [(r["id"], r["k"], r["start"], r["part"][0]) for r in found] == [(1, 0, 0, 0.0), (1, 1, 3, 3.0), (1, 2, 6, 6.0)]
    t = np.arange(640) / 64
    tone = spark.createDataFrame([(np.sin(2 * np.pi * 1.5 * t).tolist(),), (None,), ([],)], "w array<double>")
    best = spark.sql("SELECT max_by(bpm, power) AS bpm, sum(share) AS share, count(*) AS n FROM {r}, LATERAL evidence(w, 64.0D, 40.0D, 220.0D, 2.0D)", r=tone).first()
    assert best["bpm"] == 90 and np.isclose(best["share"], 1) and best["n"] == 91


@pytest.mark.parametrize("name", ["yeo_johnson", "permuted_folds", "subject_union", "sub_window_table", "evidence_table", "ewma_series", "gate_search_one_column", "ridge_folds_one_column", "ridge_cv", "ridge_leave_one_out", "ridge_cv_two_columns", "elastic_net_choice", "representative_event", "skin_response", "slow_channels", "movement", "skin_shape", "target_prior", *source_queries.QUERIES])
def test_new_queries_equal_their_sql(spark, name):
    assert name in queries.ORACLE_SQL
    equals_its_sql(spark, name, "/root/testdata/sf0.001")


def test_representative_window_of_the_smallest_archive(spark, tmp_path):
    hr = R.normal(size=(9, 300))
    hr[0, 5] = np.nan
    acc = R.normal(size=(9, 9600, 3))
    glucose = np.array([100.0, 90, 80, 120, np.nan, 100, 95, 130, 70])
    np.savez(tmp_path / "big.npz", e4_hr=R.normal(size=(40, 300)), glucose=np.arange(40.0), e4_acc=np.ones((40, 9600, 3)))
    np.savez(tmp_path / "small.npz", e4_hr=hr, glucose=glucose, e4_acc=acc, timestamp=np.arange(9.0))
    found = tasks.representative_subject_window(spark, str(tmp_path)).first()
    ok = [1, 2, 3, 5, 6, 7, 8]
    best = min(ok, key=lambda k: (abs(glucose[k] - np.median(glucose[ok])), k))
    square = (acc[best].astype("f4").astype(float) ** 2).sum(axis=1)
    assert found["ts"] == best and found["path"].endswith("small.npz") and np.allclose(found["squared"], square / square.mean())


def test_last_resort_is_by_position(spark):
    rows = spark.createDataFrame([("a", float(k), 3 * k) for k in range(21)], "subject_id string, ts double, row_id long").withColumn("fold", F.lit(None).cast("int"))
    (train, test), *more = tasks.protocol_splits(rows, "d3")
    assert not more and sorted(r["ts"] for r in rows.where(test).collect()) == list(range(15, 21)) and rows.where(train).count() == 15
