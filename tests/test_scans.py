"""Sums that don't cancel, searches inside cross-validation, and scans in order, against direct computation."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavespark.operators import gram as G
from wavespark.operators import joins as J
from wavespark.operators import linear as L
from wavespark.operators import ordered as O
from wavespark.operators import search as SE

R = np.random.default_rng(12)


def frame(spark, x, y, parts=6, **more):
    names = list(more)
    rows = [(k, x[k].tolist(), float(y[k]), *[v[k].item() for v in more.values()]) for k in range(len(y))]
    kinds = ["double" if np.asarray(v).dtype.kind == "f" else "int" for v in more.values()]
    return spark.createDataFrame(rows, "row_id long, x array<double>, y double" + "".join(f", {n} {k}" for n, k in zip(names, kinds, strict=True))).repartition(parts)


# ------------------------------------------------------------------ sums


@pytest.mark.parametrize("p", [3, 20])
@pytest.mark.parametrize("weighted", [False, True])
def test_sums_of_large_means_keep_their_digits(spark, p, weighted):
    x = R.normal(size=(500, p)) + 1e8
    y = (x - 1e8) @ np.arange(1.0, p + 1) + 1e7 + R.normal(size=500)
    w = R.uniform(0.5, 2, 500) if weighted else np.ones(500)
    found = G.normal_equations(frame(spark, x, y, fold=np.arange(500) % 3, w=w), p, fold="fold", weight="w" if weighted else None)
    z = np.column_stack([x - 1e8, y - 1e7])
    for f, n in found.items():
        at = np.arange(500) % 3 == f
        mean = np.average(z[at], axis=0, weights=w[at])
        assert np.allclose(n.spread, ((z[at] - mean) * w[at, None]).T @ (z[at] - mean), rtol=1e-5, atol=1e-5)
        assert np.isclose(n.weight, w[at].sum()) and np.allclose(n.mean - np.append(np.full(p, 1e8), 1e7), mean, atol=1e-6)
    everything = G.total(found)
    rest = everything - found[0]
    assert np.allclose(rest.spread, (found[1] + found[2]).spread, rtol=1e-5, atol=1e-4)
    assert np.allclose(L.ols(everything).coef, np.arange(1.0, p + 1), atol=0.3)
    assert np.isclose(np.sqrt(everything.spread[0, 0] / everything.weight), np.sqrt(np.average((z[:, 0] - np.average(z[:, 0], weights=w)) ** 2, weights=w)), rtol=1e-6)


def test_what_is_sent_follows_the_cores(spark):
    x, y = R.normal(size=(400, 30)), R.normal(size=400)
    rows = frame(spark, x, y, parts=100)
    slim = rows.select(F.lit(0).alias("fold"), "x", "y", F.lit(1.0).alias("w"))
    blocks = -(-31 // (200 // 31))
    sent = G.partial_sums(slim, 30, block=200)
    assert sent.count() <= spark.sparkContext.defaultParallelism * blocks
    assert sent.select(F.max(F.size("part"))).first()[0] <= 200
    for fan_in in (2, 8):
        n = G.normal_equations(rows, 30, block=200, fan_in=fan_in)[0]
        z = np.column_stack([x, y]) - np.append(x.mean(0), y.mean())
        assert np.allclose(n.spread, z.T @ z) and np.isclose(n.squares, y @ y)


def test_nothing_is_taken_from_nothing():
    n = G.Normal.of(R.normal(size=(4, 3)), np.ones(4))
    nothing = n - n
    assert nothing.weight == 0 and np.allclose((nothing + n).spread, n.spread) and np.allclose((n - nothing).mean, n.mean)
    assert n.columns([1]).width == 1 and np.isclose(n.columns([1]).spread[0, 1], n.spread[1, 2])


# ------------------------------------------------------------------ search


def left_out(x, y, penalty):
    """Mean squared error of refits without each row, columns standardised and the mean taken on all rows."""
    mean, scale = x.mean(0), x.std(0)
    z = np.column_stack([np.ones(len(y)), (x - mean) / scale])
    errors = []
    for k in range(len(y)):
        keep = np.arange(len(y)) != k
        w = np.linalg.solve(z[keep].T @ z[keep] + penalty * np.diag([0.0, *[1.0] * x.shape[1]]), z[keep].T @ y[keep])
        errors.append((y[k] - z[k] @ w) ** 2)
    return np.mean(errors)


def fitted(x, y, penalties):
    errors = [left_out(x, y, a) for a in penalties]
    a = penalties[int(np.argmin(errors))]
    mean, scale = x.mean(0), x.std(0)
    z = (x - mean) / scale
    w = np.linalg.solve(z.T @ z + a * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return a, lambda t: y.mean() + (t - mean) / scale @ w


@pytest.mark.parametrize("held", [1 << 28, 3000])
def test_gate_search_equals_direct_refits(spark, held):
    n, p = 60, 4
    x = np.clip(R.normal(size=(n, p)) * 0.4, -1, 1)
    gated = [SE.Gate((0, 2), s) for s in (0.0, 0.3, 0.6)]
    y = gated[1].values(x) @ np.array([3.0, 0.2, -2.0, 0.1]) + 0.5 * R.normal(size=n)
    fold, penalties = np.arange(n) % 3, (0.01, 1.0, 30.0)
    rows = frame(spark, x, y, fold=fold)
    found = SE.nested_search(rows, p, gated, penalties, held=held)
    want = []
    for g in gated:
        z, errors = g.values(x), []
        for f in range(3):
            _, model = fitted(z[fold != f], y[fold != f], penalties)
            errors.append(((y - model(z))[fold == f] ** 2).mean())
        want.append(np.mean(errors))
    assert np.allclose(found.errors, want) and found.best == int(np.argmin(want))
    best = gated[found.best]
    penalty, model = fitted(best.values(x), y, penalties)
    assert found.penalties[found.best] == penalty
    got = [r["p"] for r in found.predict(rows).orderBy("row_id").collect()]
    assert np.allclose(got, model(best.values(x)))
    assert found.predict(rows).columns == [*rows.columns, "p"]


def test_search_over_alike_rows_is_the_search_over_all(spark):
    n, p = 400, 3
    x = R.integers(-2, 3, (n, p)) / 2.5
    y = 1e3 + np.abs(x[:, 0]) * 3 + x[:, 1] + R.normal(size=n)
    rows = frame(spark, x, y, fold=R.integers(0, 3, n))
    assert SE.alike_rows(rows).count() < 350 and SE.alike_rows(rows).agg(F.sum("weight")).first()[0] == n
    gates = [SE.Gate((0,), s) for s in (0.0, 0.3, 0.6)]
    every, alike = (SE.nested_search(rows, p, gates, (0.1, 3.0, 100.0), alike=a) for a in (False, True))
    assert np.allclose(every.errors, alike.errors, rtol=1e-11) and (every.best, every.penalties) == (alike.best, alike.penalties)
    assert np.allclose(every.model.coef, alike.model.coef, rtol=1e-9)


def test_search_needs_folds(spark):
    with pytest.raises(ValueError, match="folds"):
        SE.nested_search(frame(spark, R.normal(size=(9, 2)), R.normal(size=9), fold=np.zeros(9, int)), 2, [SE.Gate((0,), 0.1)])


# ------------------------------------------------------------------ order


def averages(values, half_life):
    keep, level, var = 0.5 ** (1 / half_life), values[0], 0.0
    out = [(level, var)]
    for v in values[1:]:
        level = keep * level + (1 - keep) * v
        var = keep * var + (1 - keep) * (v - level) ** 2
        out.append((level, var))
    return out


@pytest.mark.parametrize("chunk,parts", [(2, 5), (7, 1), (4096, 3)])
def test_averages_of_long_series(spark, chunk, parts):
    series = {"a": R.normal(size=300).cumsum() + 5, "b": R.normal(size=8), None: R.normal(size=3), "c": R.normal(size=1)}
    rows = [(k, t, t, float(v)) for k, values in series.items() for t, v in enumerate(values)]
    df = spark.createDataFrame(rows, "s string, t int, id int, v double").repartition(4)
    got = {r["s"]: r for r in O.ewma(df, "s", "t", "id", "v", 8, parts, chunk).collect()}
    filled = {(r["s"], r["_place"]): r for r in O.ewma_filled(df, "s", "t", "id", "v", 8, parts, chunk).collect()}
    assert len(got) == 4 and len(filled) == len(rows)
    for k, values in series.items():
        want = averages(values.tolist(), 8)
        assert np.allclose([got[k]["level"], got[k]["std"], got[k]["momentum"]], [want[-1][0], np.sqrt(want[-1][1] + 1e-12), want[-1][0] - values.mean()])
        assert np.allclose([(filled[k, i + 1]["_level"], filled[k, i + 1]["_var"]) for i in range(len(values))], want)


def test_no_series(spark):
    none = spark.createDataFrame([], "s string, t int, id int, v double")
    assert O.ewma(none, "s", "t", "id", "v", 8).collect() == [] == O.ewma_filled(none, "s", "t", "id", "v", 8).collect()


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_previous_and_place_with_ties_and_nulls(spark, parts):
    rows = [(None if k % 11 == 0 else int(R.integers(0, 3)), int(R.integers(0, 9)), k) for k in range(200)]
    df = spark.createDataFrame(rows, "s int, t int, id int").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    want, seen = {}, {}
    for s, t, k in ordered:
        want[k] = (seen.get(s, (None, 0))[0], seen.get(s, (None, 0))[1] + 1)
        seen[s] = (t, want[k][1])
    assert {r["id"]: r["_previous"] for r in J.previous(df, "s", "t", "id", parts).collect()} == {k: v[0] for k, v in want.items()}
    assert {r["id"]: (r["_place"], r["_count"]) for r in J.place_in_order(df, "s", "t", "id", parts).collect()} == {k: (want[k][1], seen[s][1]) for s, _, k in rows}


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_nearest_value_over_partitions(spark, parts):
    left = [(int(R.integers(0, 3)), None if k % 17 == 0 else int(R.integers(0, 30)), k) for k in range(120)]
    right = [(int(R.integers(0, 4)), int(R.integers(0, 30)), None if k % 9 == 0 else k) for k in range(60)] + [(0, None, 999)]
    a, b = spark.createDataFrame(left, "s int, t int, id int"), spark.createDataFrame(right, "s int, t int, v int")
    for clip in (False, True):
        got = {r["id"]: r["v"] for r in J.asof_forward(a, b, ["s"], "t", "v", clip, parts).collect()}
        assert len(got) == len(left)
        for s, t, k in left:
            known = [(u, v) for z, u, v in right if z == s and u is not None and v is not None]
            after, before = [u for u, _ in known if t is not None and u >= t], [u for u, _ in known]
            at = None if t is None or not known else min(after) if after else max(before) if clip else None
            assert got[k] in ({v for u, v in known if u == at} if at is not None else {None})


def test_a_key_of_many_rows_is_spread(spark):
    n = 10_000_000
    rows = spark.range(0, n, 1, 8).select(F.lit(1).alias("s"), F.col("id").alias("t"), (F.col("id") % 10).cast("double").alias("v"))
    began = time.time()
    dealt = O.dealt(rows, ["s", "t"], 16)
    sizes = [r["count"] for r in dealt.groupBy("_part").count().collect()]
    assert sum(sizes) == n and max(sizes) < n / 8
    found = O.ewma(rows, "s", "t", "t", "v", 8, 16).first()
    assert found["n"] == n and np.isclose(found["level"], averages([k % 10 for k in range(200)], 8)[-1][0])
    assert time.time() - began < 240
