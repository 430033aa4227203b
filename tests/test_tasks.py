"""Sources, kernels and the four tasks."""

import inspect
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.functions import arrays as A
from wavespark.functions import physio as P
from wavespark.functions import surfaces as S
from wavespark.operators import gram as G
from wavespark.operators import joins as J
from wavespark.operators import linear as L
from wavespark.operators import selection as SEL
from wavespark.operators import splits, transforms
from wavespark.operators.kernels import apply_kernel
from wavespark.operators.quantiles import exact_quantiles
from wavespark.plans import queries, tasks
from wavespark.sources import subjects as sub
from wavespark.sources import windows as src


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    """A training and a test file of 5 columns, with exact weights."""
    r, folder = np.random.default_rng(1), tmp_path_factory.mktemp("csv")
    x = r.normal(size=(300, 5))
    y = 70 + x @ np.array([1.0, -2.0, 0.5, 0.0, 3.0]) + 0.1 * r.normal(size=300)
    for name, rows, target in (("train", slice(0, 200), True), ("test", slice(200, 300), False)):
        with open(folder / f"{name}.csv", "w") as f:
            f.write("a,b,hr,c,d,e\n" if target else "a,b,c,d,e\n")
            for v, t in zip(x[rows], y[rows], strict=True):
                cells = [*v[:2], t, *v[2:]] if target else v
                f.write(",".join(f"{c:.12g}" for c in cells) + "\n")
    (folder / "folds.txt").write_text("ends = [50, 100, 150, 200]\n")
    (folder / "lambdas.txt").write_text("0.1\n\n1\n100\n")
    return folder, x, y


def test_read_table_keeps_order_and_columns(spark, csv):
    folder, x, y = csv
    rows = src.read_table(spark, f"{folder}/train.csv", width=5).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(200))
    assert np.allclose([r["x"] for r in rows], x[:200]) and np.allclose([r["y"] for r in rows], y[:200])
    with pytest.raises(ValueError, match="columns"):
        src.read_table(spark, f"{folder}/train.csv", width=6)
    assert src.check_table(src.read_table(spark, f"{folder}/test.csv", width=5)).first().asDict() == {"n": 100, "bad": 0, "targets": 0}


def test_rows_are_numbered_over_many_splits(spark, tmp_path):
    lines = [f"line {k} {'x' * (k % 17)}" for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = src.numbered_lines(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["value"] for r in found] == lines and [r["row_id"] for r in found] == list(range(5000))


def test_task_a_is_least_squares(spark, csv):
    folder, x, y = csv
    p, model = tasks.task_a(spark, f"{folder}/train.csv", f"{folder}/test.csv", width=5)
    w = np.linalg.lstsq(np.column_stack([np.ones(200), x[:200]]), y[:200], rcond=None)[0]
    assert np.allclose(np.r_[model.intercept, model.coef], w)
    found = [r["p"] for r in p.orderBy("row_id").collect()]
    assert np.allclose(found, w[0] + x[200:] @ w[1:])
    check = tasks.check_predictions(src.read_table(spark, f"{folder}/test.csv", width=5), p, model).first()
    assert (check["n"], check["bad"]) == (100, 0)


def test_task_b_matches_direct_cross_validation(spark, csv, tmp_path):
    folder, x, y = csv
    paths = [f"{folder}/{n}" for n in ("train.csv", "test.csv", "folds.txt", "lambdas.txt")]
    p, model, penalties, errors, best = tasks.task_b(spark, *paths, width=5)
    z = np.column_stack([np.ones(200), x[:200]])
    shrink = np.diag([0, 1, 1, 1, 1, 1])
    want = []
    for lam in (0.1, 1, 100):
        e = []
        for a in range(0, 200, 50):
            test = (np.arange(200) >= a) & (np.arange(200) < a + 50)
            w = np.linalg.solve(z[~test].T @ z[~test] + lam * shrink, z[~test].T @ y[:200][~test])
            t = y[:200][test]
            e.append(((t - z[test] @ w) ** 2).sum() / ((t - t.mean()) ** 2).sum())
        want.append(np.mean(e))
    assert penalties == [0.1, 1, 100] and np.allclose(errors, want) and best == int(np.argmin(want))
    src.write_vector(p, f"{tmp_path}/p", "p")
    back = src.read_vector(spark, f"{tmp_path}/p", 100).orderBy("row_id").collect()
    assert np.allclose([r["value"] for r in back], [r["p"] for r in p.orderBy("row_id").collect()], atol=1e-9)
    with pytest.raises(ValueError):
        src.read_vector(spark, f"{tmp_path}/p", 99)
    assert src.read_bracketed_folds(spark, f"{folder}/folds.txt", 200) == [50, 100, 150, 200]


def _design(spark, n=120, p=20, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, p)) + 2
    y = x @ r.normal(size=p) + 5 + r.normal(size=n)
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k]), k % 4) for k in range(n)], "row_id long, x array<double>, y double, fold int")
    return rows, x, y


def test_wide_and_narrow_normal_equations_agree(spark):
    rows, x, y = _design(spark)
    wide = G.normal_equations(rows, 20, fold="fold")
    z = np.column_stack([np.ones(120), x])
    for f, n in wide.items():
        at = np.arange(120) % 4 == f
        assert np.allclose(n.gram, z[at].T @ z[at]) and np.allclose(n.moment, z[at].T @ y[at])
    narrow = G.normal_equations(rows.withColumn("x", F.slice("x", 1, 3)), 3)[0]
    assert np.allclose(narrow.gram, z[:, :4].T @ z[:, :4]) and np.isclose(narrow.squares, y @ y)


def test_models_meet_their_conditions(spark):
    rows, x, y = _design(spark, p=6)
    n = G.normal_equations(rows, 6)[0]
    for lam, path in zip((0.5, 20.0), L.ridge_path(n, (0.5, 20.0)), strict=True):
        direct = L.ridge(n, lam)
        assert np.allclose(path.coef, direct.coef) and np.isclose(path.intercept, direct.intercept)
    net = L.elastic_net(n, 0.1, 0.7)
    grad = (x - x.mean(0)).T @ (y - y.mean() - (x - x.mean(0)) @ net.coef) / 120
    for g, w in zip(grad, net.coef, strict=True):
        assert abs(g) <= 0.07 + 1e-6 if w == 0 else np.isclose(g, 0.07 * np.sign(w) + 0.03 * w, atol=1e-5)
    loo = L.leave_one_out(rows, n, [3.0])[0]
    errors = []
    for k in range(120):
        keep = np.arange(120) != k
        c, m = x[keep] - x.mean(0), y[keep] - y.mean()
        z = np.column_stack([np.ones(119), c])
        w = np.linalg.solve(z.T @ z + 3.0 * np.diag([0, *[1] * 6]), z.T @ m)
        errors.append((y[k] - y.mean() - w[0] - (x[k] - x.mean(0)) @ w[1:]) ** 2)
    assert np.isclose(loo, np.mean(errors))
    plain = L.ridge_path(n, (3.0,), centre=False)[0]
    assert np.isclose(plain.intercept, y.mean()) and np.allclose(plain.coef, np.linalg.solve(x.T @ x + 3.0 * np.eye(6), x.T @ (y - y.mean())))
    errors = L.scored(rows, [plain, net])
    for m, (nmae, nmse) in zip((plain, net), errors, strict=True):
        off, base = y - m.intercept - x @ m.coef, y - y.mean()
        assert np.isclose(nmae, np.abs(off).sum() / np.abs(base).sum()) and np.isclose(nmse, (off**2).sum() / (base**2).sum())


@pytest.mark.parametrize("weighted", [False, True])
def test_reweighting_is_as_defined(spark, weighted):
    rows, x, y = _design(spark, p=4)
    x = (x - x.mean(0)) / x.std(0)
    y = y + 100 * (np.arange(120) % 10 == 0)
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(120)], "row_id long, x array<double>, y double")
    start = L.ridge_path(G.normal_equations(rows, 4)[0], (1.0,), centre=False)[0]
    got = L.irls(rows, 4, 1.0, start, rounds=4, floor_add=1e-3, weighted_level=weighted)
    score = lambda b, w: np.abs(y - b - x @ w).sum()
    b, w = start.intercept, start.coef
    best = (score(b, w), b, w)
    for _ in range(4):
        r = y - b - x @ w
        v = 1 / np.maximum(np.abs(r), 1.345 * np.median(np.abs(r - np.median(r))) + 1e-3)
        b = (v * y).sum() / v.sum() if weighted else y.mean()
        w = np.linalg.solve((x * v[:, None]).T @ x + v.mean() * np.eye(4), x.T @ (v * (y - b)))
        best = min(best, (score(b, w), b, w), key=lambda t: t[0])
    assert np.isclose(got.intercept, best[1]) and np.allclose(got.coef, best[2])


def test_exact_quantiles(spark):
    r = np.random.default_rng(8)
    columns = {"a": r.normal(size=3000) * 10.0 ** r.integers(-8, 8, 3000), "b": r.integers(-3, 4, 3000).astype(float), "c": np.where(r.random(3000) < 0.3, np.nan, -r.random(3000)), "d": np.full(3000, np.nan), "e": np.zeros(3000)}
    columns["a"][:5] = [np.inf, -np.inf, 0.0, -0.0, 1e-320]
    rows = spark.createDataFrame(list(zip(*(v.tolist() for v in columns.values()), strict=True)), ", ".join(f"{k} double" for k in columns)).repartition(3)
    at = [0.0, 0.005, 0.31, 0.5, 0.98, 1.0]
    got = exact_quantiles(rows, {k: F.col(k) for k in columns}, at)
    for k, v in columns.items():
        v = v[np.isfinite(v)]
        assert np.allclose(got[k], np.quantile(v, at) if len(v) else np.nan, rtol=1e-12, atol=0, equal_nan=True), k
    assert np.isnan(exact_quantiles(rows.where("false"), {"a": F.col("a")}, [0.5])["a"][0])


def test_choices_by_held_out_error(spark):
    rows, x, y = _design(spark, p=5)
    x = x - x.mean(0)
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(120)], "row_id long, x array<double>, y double")
    held = F.col("row_id") >= 90
    train = G.normal_equations(rows.where(~held), 5)[0]
    penalties, m = (0.1, 10.0, 1000.0), y[:90].mean()

    def best(columns, multipliers):
        out = []
        for lam in penalties:
            z = x[:90, columns]
            w = np.linalg.solve(z.T @ z + lam * np.diag(multipliers[columns]), z.T @ (y[:90] - m))
            t = y[90:]
            out.append((np.abs(t - m - x[90:, columns] @ w).sum() / np.abs(t - t.mean()).sum(), lam, w))
        return min(out, key=lambda o: o[0])

    block_of = np.array([0, 0, 1, 1, 1])
    for label, nmae, lam in SEL.ablation(train, rows.where(held), block_of, [("one", (1.0, SEL.OFF)), ("both", (1.0, 2.0))], penalties):
        want = best(np.arange(5), np.array((1.0, SEL.OFF) if label == "one" else (1.0, 2.0))[block_of])
        assert np.isclose(nmae, want[0]) and lam == want[1]
    order, found = SEL.sweep(train, rows.where(held), np.ones(5), penalties, (2, 3, 9))
    ranked = np.argsort(-np.abs(best(np.arange(5), np.ones(5))[2]), kind="stable")
    assert order.tolist() == ranked.tolist() and [k for k, _, _ in found] == [2, 3, 5]
    for k, nmae, lam in found:
        want = best(np.sort(ranked[:k]), np.ones(5))
        assert np.isclose(nmae, want[0]) and lam == want[1]
    kept = SEL.select_by_weight(train, rows.where(held), np.ones(5), penalties, (2, 3))
    assert kept.tolist() == np.sort(ranked[: min(found, key=lambda f: f[1])[0]]).tolist()


def test_out_of_fold_predictions(spark):
    rows, x, y = _design(spark, p=3)
    x = (x - x.mean(0)) / x.std(0)
    rows = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(120)], "row_id long, x array<double>, y double").repartition(3)
    got = SEL.cross_validated(rows, 120, 3, np.array([0, 0, 1]), [(1.0, 1.0), (0.1, 10.0)], [0.1, 10.0, 1000.0], folds=4)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1  # the rows are read once, not once a fold
    table = {r["fold"]: r for r in SEL.cross_validation_table(got).collect()}
    found = {r["row_id"]: r for r in got.collect()}
    assert len(found) == 120 and set(table) == {"1", "2", "3", "4", "mean", "std", "pooled"}
    for k in range(4):
        own = np.arange(120) // 30 == k
        assert found[30 * k]["middle"] == np.median(y[~own]) and found[30 * k]["fold"] == k
        train = spark.createDataFrame([(i, x[j].tolist(), float(y[j])) for i, j in enumerate(np.flatnonzero(~own).tolist())], "row_id long, x array<double>, y double")
        m = L.block_ridge(train, 3, np.array([0, 0, 1]), [(1.0, 1.0), (0.1, 10.0)], [0.1, 10.0, 1000.0], F.col("row_id") >= 67)
        p = np.clip(m.intercept + x[own] @ m.coef, *L.clip_range(y[~own].min(), y[~own].max()))
        assert np.allclose([found[i]["p"] for i in np.flatnonzero(own).tolist()], p)
        t = y[own]
        assert np.isclose(table[str(k + 1)]["nmae"], np.abs(t - p).sum() / np.abs(t - t.mean()).sum())
    by_fold = [table[str(k)]["nmae"] for k in range(1, 5)]
    assert np.isclose(table["mean"]["nmae"], np.mean(by_fold)) and np.isclose(table["std"]["nmae"], np.std(by_fold)) and table["pooled"]["median"] is None


def test_transforms(spark):
    rows = spark.createDataFrame([(k, float(k), float("nan") if k % 5 == 0 else k * 2.0, 1.0) for k in range(50)], "id long, a double, b double, c double")
    fitted = transforms.fit_robust(rows, ["a", "b", "c"])
    assert fitted.names_out == ["a", "b"]
    got = fitted.apply(rows).agg(F.avg("a"), F.stddev_pop("b"), F.count_if(F.isnan("b"))).first()
    assert abs(got[0]) < 1e-9 and abs(got[1] - 1) < 1e-6 and got[2] == 0
    skewed = spark.createDataFrame([(float(np.exp(v)),) for v in np.linspace(-2, 2, 400)], "v double")
    assert transforms.fit_yeo_johnson(skewed, ["v"])["v"] < 0.2
    assert J.align(rows, ["b", "z"]).columns == ["b", "z"]
    bent, lam, scale = transforms.power_transform(skewed, ["v"])
    v = np.exp(np.linspace(-2, 2, 400))
    t = ((v + 1) ** lam["v"] - 1) / lam["v"] if abs(lam["v"]) > 1e-12 else np.log1p(v)
    assert np.allclose(np.sort([r["v"] for r in bent.collect()]), (t - t.mean()) / t.std())


def test_percentiles_are_of_imputed_values(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=1000)
    v[r.random(1000) < 0.6] = np.nan
    rows = spark.createDataFrame([(float(x), float("nan")) for x in v], "v double, none double")
    fitted = transforms.fit_robust(rows, ["v", "none"])
    filled = np.where(np.isnan(v), np.nanmedian(v), v)
    low, high = np.percentile(filled, (0.5, 99.5))
    kept = np.clip(filled, low, high)
    assert np.allclose([fitted.median[0], fitted.low[0], fitted.high[0], fitted.mean[0], fitted.scale[0]], [np.nanmedian(v), low, high, kept.mean(), kept.std() + 1e-9])
    assert fitted.names_out == ["v"] and (fitted.median[1], fitted.low[1], fitted.high[1]) == (0.0, 0.0, 1.0)


def test_standard_scale(spark):
    rows = spark.createDataFrame([(float(k), 3.0) for k in range(10)], "a double, b double")
    plain, added = transforms.fit_standard(rows, ["a", "b"]), transforms.fit_standard(rows, ["a", "b"], 1e-8)
    assert np.allclose(plain.scale, [np.std(np.arange(10)), 1.0]) and np.allclose(added.scale, [np.std(np.arange(10)) + 1e-8, 1e-8])
    assert np.allclose(sorted(r["a"] for r in plain.apply(rows).collect()), (np.arange(10) - 4.5) / np.std(np.arange(10)))


def test_splits(spark):
    rows = spark.createDataFrame([(k, k % 3, 100 - k) for k in range(30)], "row_id long, s int, t int")
    split = splits.temporal(rows, "s", "t").groupBy("s").agg(F.count_if("test").alias("n"), F.max(F.when(~F.col("test"), F.col("t"))).alias("a"), F.min(F.when(F.col("test"), F.col("t"))).alias("b")).collect()
    assert all(r["n"] == 3 and r["a"] < r["b"] for r in split)
    for n in (1, 7):
        placed = J.place_in_order(rows, "s", "t", "row_id", n).collect()
        assert all(r["_count"] == 10 and r["_place"] == sum(q["s"] == r["s"] and q["t"] <= r["t"] for q in placed) for r in placed)
    parts = splits.temporal_parts(rows, "s", "t", [0.5, 0.75]).groupBy("s", "part").count().collect()
    assert sorted((r["part"], r["count"]) for r in parts) == [(0, 5)] * 3 + [(1, 2)] * 3 + [(2, 3)] * 3
    parts = splits.shuffled(rows, 30).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in parts) == [6] * 5
    assert splits.equal_parts(10, 3) == [3, 6, 10]


def equals_its_sql(spark, name, folder):
    """The rows of a query, after comparing them with those of its SQL."""
    own = queries.QUERIES[name](spark, folder).toPandas()
    with duckdb.connect() as db:
        for t in ("events", "embeddings", "lineitem", "orders"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = db.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(own.columns) == sorted(want.columns) and len(own) == len(want)
    keys = sorted(own.columns, key=lambda c: (str(own[c].dtype).startswith("float"), c))
    own, want = own.sort_values(keys, ignore_index=True), want.sort_values(keys, ignore_index=True)
    for c in keys:
        if str(own[c].dtype) in ("object", "str", "string"):
            assert own[c].tolist() == want[c].tolist(), c
        else:
            assert np.allclose(own[c].astype(float), want[c].astype(float), atol=2e-6, equal_nan=True), c
    return own


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_event_is_in_a_fold(spark, sf):
    found = equals_its_sql(spark, "fold_range_join", f"/root/testdata/{sf}")
    assert found["n"].sum() == spark.read.parquet(f"/root/testdata/{sf}/events.parquet").count()


def test_functions_are_given_at_every_sample(spark):
    found = equals_its_sql(spark, "sample_functions", "/root/testdata/sf0.001")
    assert len(found) == 64 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()


@pytest.mark.parametrize("name, width", [("bump_basis_all", 9), ("tensor_basis_all", 15)])
def test_bases_are_expanded_row_by_row(spark, name, width):
    found = equals_its_sql(spark, name, "/root/testdata/sf0.001")
    assert len(found) == width * spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


def test_registered_models_search_the_full_grids(spark, monkeypatch):
    tried = {}

    def block_ridge(rows, p, block_of, presets, penalties, held):
        tried["presets"], tried["penalties"] = presets, penalties
        return L.Linear(0.0, np.zeros(p))

    def elastic_net_cv(parts, alphas, ratios):
        tried["alphas"], tried["ratios"] = alphas, ratios
        return 1.0, 1.0, L.Linear(0.0, np.zeros(4))

    monkeypatch.setattr(L, "block_ridge", block_ridge)
    monkeypatch.setattr(L, "elastic_net_cv", elastic_net_cv)
    for name in ("block_ridge_l1", "elastic_net_cv"):
        queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    presets, penalties = (f.default for f in (inspect.signature(tasks.fit_heart_rate).parameters[k] for k in ("presets", "penalties")))
    assert tuple(tried["presets"]) == presets and tuple(tried["penalties"]) == penalties and len(penalties) == 27
    assert np.allclose(tried["alphas"], np.logspace(-2, 2, 50)) and tuple(tried["ratios"]) == (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0)


def test_asof_forward_matches_search(spark):
    r = np.random.default_rng(3)
    a, b = np.sort(r.uniform(0, 10, 40)), np.sort(r.uniform(0, 9, 25))
    left = spark.createDataFrame([(0, float(v)) for v in a], "k int, t double")
    right = spark.createDataFrame([(0, float(v), float(v)) for v in b], "k int, t double, next double")
    got = [x["next"] for x in J.asof_forward(left, right, ["k"], "t", "next", clip=True).orderBy("t").collect()]
    assert np.allclose(got, b[np.minimum(np.searchsorted(b, a), len(b) - 1)])
    assert J.asof_forward(left, right, ["k"], "t", "next").where("next IS NULL").count() == (a > b[-1]).sum()
    for n in (1, 3, 30):
        got = [x["next"] for x in J.asof_forward(left, right, ["k"], "t", "next", clip=True, parts=n).orderBy("t").collect()]
        assert np.allclose(got, b[np.minimum(np.searchsorted(b, a), len(b) - 1)])


def test_asof_forward_by_key_and_ties(spark):
    r = np.random.default_rng(5)
    left = [(int(k), int(t)) for k, t in zip(r.integers(0, 4, 60), r.integers(0, 20, 60), strict=True)]
    right = [(int(k), int(t)) for k, t in zip(r.integers(0, 3, 40), r.integers(0, 20, 40), strict=True)]
    got = J.asof_forward(spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "i int, k int, t int"), spark.createDataFrame(right, "k int, t int").withColumn("at", F.col("t")), ["k"], "t", "at")
    assert {x["i"]: x["at"] for x in got.collect()} == {i: min((u for j, u in right if j == k and u >= t), default=None) for i, (k, t) in enumerate(left)}


def test_a_long_key_takes_seconds(spark):
    n = 40_000
    left = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(0, n, 3).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.col("id").alias("at"))
    began = time.time()
    assert J.asof_forward(left, right, ["k"], "t", "at").where("at - t BETWEEN 0 AND 2 OR at IS NULL").count() == n
    assert time.time() - began < 25


@pytest.mark.parametrize("bpm", [52.0, 75.0, 120.0, 160.0])
def test_estimators_find_a_pure_tone(spark, bpm):
    t = np.arange(640) / 64
    x = np.sin(2 * np.pi * bpm / 60 * t)
    c = S.scalars(x[None], np.random.default_rng(0).normal(size=(1, 3, 320)), np.ones((1, 40)), S.log_prior(np.ones(360)))
    assert len(c) == 196 and all(np.isfinite(v).all() for v in c.values())
    for k in ("P_pk", "AR_pk", "G5_pk"):
        assert abs(c[k][0] - bpm) < 2.5
    row = spark.createDataFrame([(x.tolist(),)], "w array<double>").select(A.autocorr_bpm(F.col("w"), 64)["bpm"]).first()
    assert abs(row[0] - bpm) < 5


def test_columns_equal_kernels(spark):
    """The column expressions and the batch kernels give the same numbers."""
    r = np.random.default_rng(5)
    x = r.normal(size=(6, 64))
    x[2, 10:30] = np.nan
    x[3] = np.nan
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "row_id long, w array<double>")
    own = rows.select("row_id", *[c.alias(k) for k, c in A.nan_stats(F.col("w"), "w_").items()]).orderBy("row_id").toPandas()
    kernel = P.signal_stats(x, "w")
    for k, v in kernel.items():
        assert np.allclose(own[k], v, atol=1e-9), k
    smooth = rows.where("row_id < 2").select(A.centred_mean(F.col("w"), 5).alias("s")).collect()
    assert np.allclose([s["s"] for s in smooth], S.moving_average(x[:2], 5))


def test_filters_and_spectra():
    t = np.arange(6000) / 100
    x = np.sin(2 * np.pi * 2 * t) + np.sin(2 * np.pi * 20 * t)
    low = P.zero_phase(x[None], 100, high=5.0)[0]
    assert np.abs(low[200:-200] - np.sin(2 * np.pi * 2 * t)[200:-200]).max() < 0.02
    f, p = P.welch(x[None], 100, 1000)
    assert np.isclose(np.trapezoid(p[0], f), x.var(), rtol=0.02) and f[p[0].argmax()] in (2.0, 20.0)
    assert P.local_peaks(np.array([0, 1, 0, 2, 2, 2, 0, 1.5, 0]), 0.5, 3).tolist() == [1, 4, 7]
    assert P.local_peaks(np.array([0, 1, 0, 2, 0]), 0.5, 3).tolist() == [3]


def test_beats_give_rate_and_arrival_time():
    beats = np.arange(0.5, 299, 60 / 70)
    train = lambda hz, delay, width: np.exp(-0.5 * (np.abs(np.arange(300 * hz)[:, None] / hz - beats[None] - delay).min(axis=1) / width) ** 2)[None]
    c, heart = P.ecg(train(250, 0.0, 0.02))
    d, pulse = P.bvp(train(64, 0.22, 0.12))
    assert abs(c["ecg_hr"][0] - 70) < 0.5 and abs(d["ppg_hr"][0] - 70) < 1 and c["ecg_sdnn"][0] < 0.02
    assert 0.08 < P.arrival_times(heart, pulse)["pat_med"][0] < 0.6
    empty = P.features({"e4_eda": np.full((2, 1200), np.nan)}, 2)
    assert all(np.isfinite(v).all() for v in empty.values())


def test_heart_rate_task(spark):
    r = np.random.default_rng(2)
    rows, t = [], np.arange(640) / 64
    for k in range(60):
        bpm = 55 + 90 * r.random()
        pulse = np.sin(2 * np.pi * bpm / 60 * t + r.random()) + 0.1 * r.normal(size=640)
        rows.append((k, float(bpm), pulse.tolist(), r.normal(size=960).tolist(), np.abs(r.normal(size=40)).tolist()))
    windows = spark.createDataFrame(rows, "row_id long, y double, bvp array<double>, motion array<double>, eda array<double>")
    model = tasks.fit_heart_rate(windows, 60, penalties=L.LAMBDAS_C[10:11], presets=((1.0, 1.0),))
    assert len(model.linear.coef) == 1960
    p = model.predict(windows).join(windows, "row_id").agg(F.avg(F.abs(F.col("p") - F.col("y")))).first()[0]
    assert p < 5


def test_window_layout(spark):
    x = np.arange(1640.0)
    row = spark.createDataFrame([(0, None, x.tolist())], "row_id long, y double, x array<double>")
    got = tasks.window_columns(row).first()
    blocks = x.reshape(10, 164)
    assert got["bvp"] == blocks[:, 96:160].ravel().tolist() and got["eda"] == blocks[:, 160:].ravel().tolist()
    assert got["motion"] == np.concatenate([blocks[:, 32 * k : 32 * k + 32].ravel() for k in range(3)]).tolist()


def test_glucose_task(spark, tmp_path):
    rows = sub.synthetic(spark, subjects=3, windows=8)
    channels = ["e4_hr", "e4_temp"]
    features = tasks.subject_features(rows, channels).persist()
    assert features.count() == 24 and features.where("isnan(temp_mean)").count() == 0
    state = tasks.fit_glucose(features, "d2", penalties=(1.0, 100.0), most=12)
    assert len(state["feature_names"]) == 12 and np.isfinite(state["cv_nmae"])
    src.write_model(spark, f"{tmp_path}/m", state)
    back = src.read_model(spark, f"{tmp_path}/m")
    assert back == state
    p = tasks.apply_glucose(features.drop("e4hr_delta"), back)
    assert p.where("p IS NULL OR isnan(p)").count() == 0
    features.unpersist()


def glucose_table(subjects=3, windows=10, seed=4):
    """subject, time, glucose and features with holes, as a list of rows and as arrays."""
    r = np.random.default_rng(seed)
    sid, ts = np.repeat(np.arange(subjects), windows), np.tile(np.arange(windows) * 300.0, subjects)
    x = r.normal(size=(len(sid), 4)) + sid[:, None] * [1, 0, -1, 0]
    y = 100 + x @ [5, -3, 2, 0] + r.normal(size=len(sid)) + 4 * sid
    x[r.random(x.shape) < 0.1] = np.nan
    rows = [(int(k), f"s{s}", float(t), float(g), *map(float, v)) for k, (s, t, g, v) in enumerate(zip(sid, ts, y, x, strict=True))]
    return rows, sid, ts, x, y


@pytest.mark.parametrize("protocol", ["d1", "d2", "d3"])
def test_glucose_protocols_against_direct_computation(spark, protocol):
    rows, sid, ts, x, y = glucose_table()
    columns = "row_id long, subject_id string, ts double, glucose double, a double, b double, c double, d double"
    table = spark.createDataFrame([*rows, (-1, "s0", 9e9, float("nan"), 1.0, 1.0, 1.0, 1.0), (31, "s1", 9e9, None, 1.0, 1.0, 1.0, 1.0)], columns).repartition(3)
    penalties = (0.1, 1.0, 30.0)
    state = tasks.fit_glucose(table, protocol, penalties)
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    low, high = np.percentile(filled, (0.5, 99.5), axis=0)
    kept = np.clip(filled, low, high)
    z = (kept - kept.mean(0)) / (kept.std(0) + 1e-9)
    if protocol == "d1":
        order = np.random.RandomState(0).permutation(30)
        cuts = [(np.setdiff1d(np.arange(30), f), f) for f in np.array_split(order, 5)]
    elif protocol == "d2":
        place = np.tile(np.arange(10), 3)
        cuts = [(np.flatnonzero(place < 7), np.flatnonzero(place >= 7)), (np.flatnonzero(place < 5), np.flatnonzero((place >= 5) & (place < 7)))]
    else:
        cuts = [(np.flatnonzero(sid != s), np.flatnonzero(sid == s)) for s in range(3)]

    def centre(v, s):
        return v - np.stack([v[s == k].mean(0) for k in s])

    best = None
    for centred in (False, True) if protocol == "d3" else (False,):
        for lam in penalties:
            e = []
            for train, test in cuts:
                v = centre(z[train], sid[train]) if centred else z[train]
                w = np.linalg.solve(v.T @ v + lam * np.eye(4), v.T @ (y[train] - y[train].mean()))
                t = y[test]
                e.append(np.abs(t - y[train].mean() - z[test] @ w).sum() / np.abs(t - t.mean()).sum())
            if best is None or np.mean(e) < best[0] - 1e-12:
                best = np.mean(e), lam, centred
    assert np.isclose(state["cv_nmae"], best[0]) and (state["penalty"], state["centred"]) == best[1:]
    v = centre(z, sid) if best[2] else z
    b, w = y.mean(), np.linalg.solve(v.T @ v + best[1] * np.eye(4), v.T @ (y - y.mean()))
    score = lambda b, w: np.abs(y - b - v @ w).sum()
    top = (score(b, w), b, w)
    for _ in range(4):
        r = y - b - v @ w
        weight = 1 / np.maximum(np.abs(r), 1.345 * np.median(np.abs(r - np.median(r))) + 1e-6)
        b = (weight * y).sum() / weight.sum()
        w = np.linalg.solve((v * weight[:, None]).T @ v + best[1] * weight.mean() * np.eye(4), v.T @ (weight * (y - b)))
        top = min(top, (score(b, w), b, w), key=lambda t: t[0])
    _, b, w = top
    b = b - (z.mean(0) - v.mean(0)) @ w
    p = {r["row_id"]: r["p"] for r in tasks.apply_glucose(table.where("row_id BETWEEN 0 AND 29"), state).join(table.select("row_id", "subject_id", "ts"), ["subject_id", "ts"]).collect()}
    assert np.allclose([p[k] for k in range(30)], b + z @ w)


def test_too_few_targets_and_one_subject(spark):
    rows, *_ = glucose_table(subjects=1, windows=24)
    columns = "row_id long, subject_id string, ts double, glucose double, a double, b double, c double, d double"
    table = spark.createDataFrame(rows, columns).drop("row_id")
    assert np.isfinite(tasks.fit_glucose(table, "d3", (1.0,))["cv_nmae"])  # nobody is left to train on: a quarter of the rows is tested
    with pytest.raises(ValueError, match="fewer than 20"):
        tasks.fit_glucose(table.where("ts < 3000"), "d2", (1.0,))


def test_full_set_of_columns(spark):
    found = queries.QUERIES["subject_features"](spark, "/root/testdata/sf0.001")
    row = found.first().asDict()
    assert len(row) == 344 and all(np.isfinite(v) for k, v in row.items() if k != "subject_id")


def test_full_design(spark):
    x = np.array(queries.QUERIES["full_design"](spark, "/root/testdata/sf0.001").first()["x"])
    names = S.design_names([f"c{k}" for k in range(196)], full=True)
    blocks = np.array([b for _, b in names])
    assert len(x) == len(names) == 5032 and np.bincount(blocks).tolist() == [196, 1764, 2172, 900] and np.isfinite(x).all()
    at = {n: k for k, (n, _) in enumerate(names)}
    assert at["tns:selxlamp[r0,g1]"] == at["tns:selxlamp[r0,g0]"] + 1 and at["dist:accs@36bpm"] == 5032 - 90
    for k in range(10):
        assert np.isclose(x[4132 + 90 * k : 4222 + 90 * k].sum(), 1)  # each distribution
    assert np.isclose(x[1960 : 1960 + 135].sum(), 1, atol=1e-6)  # all products of two sets of bumps that sum to one


def test_tensors_are_products():
    r = np.random.default_rng(1)
    c = {k: r.normal(size=3) * 5 + 90 for k in (*S.TENSOR_RATES.values(), *S.GATES.values())}
    gates, pairs = {k: np.linspace(80, 100, 5) for k in S.GATES}, {k: np.linspace(80, 100, 7) for k in S.GATES}
    got, names = S.tensors(c, gates, pairs), [n for n, b in S.design_names([], full=True) if b == 2]
    bump = lambda v, knots, j: np.exp(-0.5 * ((v - knots[j]) / ((knots[-1] - knots[0]) / (len(knots) - 1))) ** 2)
    share = lambda v, knots, j: bump(v, knots, j) / (sum(bump(v, knots, i) for i in range(len(knots))) + 1e-9)
    assert np.allclose(got[:, names.index("tns:sel2xsent[r9,g3]")], share(c["S2_pk"], S.RATE_KNOTS, 9) * share(c["S_ent"], gates["sent"], 3))
    assert np.allclose(got[:, names.index("pair:laccxsent[2,6]")], share(c["a_lsd"], pairs["lacc"], 2) * share(c["S_ent"], pairs["sent"], 6))


def test_interval_statistics_are_as_defined():
    r = np.random.default_rng(2)
    beats = [np.cumsum(r.integers(50, 90, 40)), np.arange(4) * 64, np.cumsum(np.where(np.arange(60) % 9 == 0, 400, r.integers(55, 70, 60))), np.zeros(0, np.int64), np.array([0, 1, 2, 3, 4, 5, 6])]
    got = P.intervals(beats, 64, "t")
    for k in (0, 2):
        every = np.diff(beats[k]) / 64
        rr = every[(every > 0.28) & (every < 2.2)]
        assert np.isclose(got["t_acc_frac"][k], len(rr) / len(every))
        rr = rr[np.abs(rr - np.median(rr)) < 0.5 * np.median(rr) + 1e-9]
        d = np.diff(rr)
        assert got["t_nbeat"][k] == len(rr) and np.isclose(got["t_hr"][k], 60 / rr.mean()) and np.isclose(got["t_sdnn"][k], rr.std()) and np.isclose(got["t_hrstd"][k], (60 / rr).std())
        assert np.isclose(got["t_rmssd"][k], np.sqrt((d**2).mean())) and np.isclose(got["t_pnn20"][k], (np.abs(d) > 0.02).mean()) and np.isclose(got["t_sd1"][k], d.std() / np.sqrt(2))
        assert np.isclose(got["t_medrr"][k], np.median(rr)) and np.isclose(got["t_iqrrr"][k], np.subtract(*np.percentile(rr, (75, 25)))) and np.isclose(got["t_rrmax"][k], rr.max())
        t = np.arange(len(rr))
        assert np.isclose(got["t_rrslope"][k], (rr * (t - t.mean()) / (t.std() + 1e-9)).mean()) and np.isclose(got["t_rrskew"][k], (((rr - rr.mean()) / rr.std()) ** 3).mean())
        f, when = np.linspace(0.003, 0.5, 120), rr.cumsum()
        grid = np.arange(0, when[-1], 0.25)
        level = np.interp(grid, when, rr)
        power = np.array([abs(((level - level.mean()) * np.exp(2j * np.pi * q * grid)).sum()) ** 2 for q in f])
        low, high = power[(f >= 0.04) & (f < 0.15)].sum(), power[(f >= 0.15) & (f < 0.4)].sum()
        assert np.isclose(got["t_lf"][k], np.log1p(low)) and np.isclose(got["t_lfhf"][k], low / (high + 1e-9))
    for k in (1, 3, 4):
        assert all(got[f"t_{n}"][k] == 0 for n in P.INTERVAL_NAMES)


def test_arrival_times_and_mean_beats_are_as_defined():
    r = np.random.default_rng(3)
    heart = [np.sort(r.choice(74000, 60, replace=False)), np.array([1, 2]), np.sort(r.choice(74000, 30, replace=False))]
    pulse = [np.sort(r.choice(19000, 55, replace=False)), np.arange(10) * 60, np.sort(r.choice(9000, 40, replace=False))]
    got = P.arrival_times(heart, pulse)
    for k in (0, 2):
        h, p = heart[k] / 250, pulse[k] / 64
        delay = np.array([next((q for q in p if q >= t), p[-1]) - t for t in h])
        d = delay[(delay > 0.08) & (delay < 0.6)]
        assert np.isclose(got["pat_frac"][k], len(d) / len(h)) and np.isclose(got["pat_med"][k], np.median(d) if len(d) >= 3 else 0) and np.isclose(got["pat_std"][k], d.std() if len(d) >= 3 else 0)
        assert np.isclose(got["hr_ecg_ppg_diff"][k], 60 / np.median(np.diff(h)) - 60 / np.median(np.diff(p)))
    assert all(v[1] == 0 for v in got.values())
    x = r.normal(size=(2, 3000))
    got = P.mean_beat(x, [np.arange(100, 2900, 30), np.array([100, 500])], 64, 0.2, 0.45, 24, "t")
    at = np.arange(100, 2900, 30)[np.linspace(0, 93, 60).astype(int)]
    beat = np.mean([x[0, a - 12 : a + 28] for a in at], axis=0)
    size = np.subtract(*np.percentile(beat, (99, 1)))
    flat = (beat - np.median(beat)) / (size + 1e-9)
    assert np.isclose(got["t_amp"][0], size) and np.allclose([got[f"t_tpl{k:02}"][0] for k in range(24)], np.interp(np.linspace(0, 39, 24), np.arange(40), flat))
    late = flat[12 + 9 : 12 + 28]
    assert np.isclose(got["t_twave"][0], late[np.abs(late).argmax()]) and np.isclose(got["t_tarea"][0], np.trapezoid(late) / 64) and np.isclose(got["t_rough"][0], np.abs(np.diff(flat)).mean())
    assert all(v[1] == 0 for v in got.values())


def test_prediction_model_by_levinson_is_yule_walker():
    r = np.random.default_rng(4)
    lags = np.array([np.correlate(v, v, "full")[199:210] for v in r.normal(size=(3, 200)).cumsum(1)])
    got = S.levinson(lags, 1e-3)
    for k in range(3):
        system = lags[k][np.abs(np.subtract.outer(np.arange(10), np.arange(10)))] + 1e-3 * lags[k, 0] * np.eye(10)
        assert np.allclose(got[k], np.linalg.solve(system, lags[k, 1:]))


def test_written_files(spark, tmp_path):
    src.write_errors(spark, f"{tmp_path}/e", [0.1, 1.0], [0.5, 0.25])
    assert [r[0] for r in spark.read.text(f"{tmp_path}/e").collect()] == ["0.1,0.500000", "1,0.250000"]
    src.write_best(spark, f"{tmp_path}/b", 0.31622776601)
    assert spark.read.text(f"{tmp_path}/b").first()[0] == "0.316227766"
    assert tasks.check_penalties([0.1, 1.0], [(0.1, 0.5), (1.0, 0.25)], 1.0) == {"ordered": True, "listed": True, "least": True}
    assert tasks.check_penalties([0.1, 1.0], [(1.0, 0.25), (0.1, 0.5)], 0.3) == {"ordered": False, "listed": False, "least": False}
    rows = spark.createDataFrame([("s", 1.0, 2.0), ("t", 3.0, None)], "subject_id string, a double, b double")
    with pytest.raises(ValueError, match="not finite"):
        src.write_features(rows, f"{tmp_path}/f", ["a", "b"])
    src.write_features(rows, f"{tmp_path}/f", ["a"])
    back = spark.read.parquet(f"{tmp_path}/f")
    assert src.checked_features(back, ["a"], 2).count() == 2
    with pytest.raises(ValueError, match="expected 3"):
        src.checked_features(back, ["a"], 3)
    src.write_report(queries.QUERIES["weight_summary"](spark, "/root/testdata/sf0.001").orderBy("block"), f"{tmp_path}/r")
    lines = [r[0].split("\t") for r in spark.read.text(f"{tmp_path}/r").collect()]
    assert lines[0] == ["block", "columns", "total", "mean", "largest", "share"] and [x[0] for x in lines[1:]] == ["A", "N", "R"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    equals_its_sql(spark, name, "/root/testdata/sf0.001")


def test_archives(spark, tmp_path):
    r = np.random.default_rng(0)
    np.savez(tmp_path / "s1.npz", e4_hr=r.normal(size=(3, 300)).astype("f4"), glucose=np.array([90.0, 91, 92]), subject_id=np.array(["a"] * 3), timestamp=np.arange(3) * 300.0)
    np.savez(tmp_path / "s2.npz", e4_hr=r.normal(size=(2, 300)).astype("f4"), e4_acc=r.normal(size=(2, 9600, 3)).astype("f4"))
    rows = sub.read_archives(spark, str(tmp_path)).selectExpr("subject_id", "ts", "glucose", "size(e4_hr) h", "size(e4_acc) a", "e4_bvp IS NULL AS none").collect()
    assert len(rows) == 5 and all(x["h"] == 300 and x["none"] for x in rows)
    assert sorted(x["a"] or -1 for x in rows) == [-1, -1, -1, 28800, 28800]
    assert np.isnan([x["glucose"] for x in rows if x["subject_id"] != "a"]).all()


def test_kernels_take_gaps_and_odd_lengths(spark):
    rows = spark.createDataFrame([(0, [1.0, None, 3.0]), (1, None), (2, [1.0])], "id int, w array<double>")
    got = apply_kernel(rows, lambda a, n: {"m": np.nanmean(a["w"], axis=1)}, {"w": 3}, ["id"]).orderBy("id").collect()
    assert got[0]["m"] == 2.0 and np.isnan(got[1]["m"]) and np.isnan(got[2]["m"])


@pytest.mark.parametrize("name", ["column_sweep", "ridge_cv", "elastic_net_cv", "ridge_leave_one_out", "yeo_johnson", "gram_wide", "evidence_surfaces", "beat_intervals", "beat_template", "skin_and_motion"])
def test_queries_without_sql_give_finite_rows(spark, name):
    found = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas().select_dtypes("number")
    assert len(found) and np.isfinite(found.to_numpy(float)).all()


def test_the_header_is_the_first_files_whatever_their_sizes(spark, tmp_path):
    """Spark reads the largest split first."""
    rows = [[f"{k}.5,{k},{2 * k}" for k in range(n)] for n in (0, 3, 500)]
    for k, lines in enumerate((["a,b,hr", *rows[1]], [], rows[2])):
        (tmp_path / f"part-{k}.csv").write_text("".join(f"{v}\n" for v in lines))
    found = src.read_table(spark, str(tmp_path), width=2).orderBy("row_id").collect()
    assert [r["row_id"] for r in found] == list(range(503)) and [r["x"] for r in found[2:4]] == [[2.5, 2.0], [0.5, 0.0]] and found[-1]["y"] == 998.0
    (tmp_path / "part-0.csv").write_text("")
    (tmp_path / "part-2.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        src.read_table(spark, str(tmp_path), width=2)
