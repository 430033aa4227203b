"""Queries over events and lineitem: ordered joins, splits, fitted transforms, sums for models, models and scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import gram as G
from ..operators import joins as J
from ..operators import linear as L
from ..operators import metrics as M
from ..operators import search as SEARCH
from ..operators import selection as SEL
from ..operators import splits as S
from ..operators import transforms as T
from ..operators.ordered import durable
from ..operators.quantiles import exact_quantiles, median
from . import tasks
from .fixtures import r6, rounded, table

QUERIES, ORACLE_SQL = {}, {}
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, x, y (price in thousands) and fold (by order key) of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("x"),
        (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_orderkey") % 5).cast("int").alias("fold"),
    )


@query("""WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = (SELECT min(event_type) FROM events)),
v AS (SELECT user_id, ts FROM events WHERE event_type = (SELECT max(event_type) FROM events)),
j AS (SELECT c.event_id, c.user_id, c.ts, min(v.ts) AS next FROM c LEFT JOIN v ON v.user_id = c.user_id AND v.ts >= c.ts GROUP BY 1, 2, 3)
SELECT event_id, user_id, coalesce(epoch_us(next) - epoch_us(ts), -1) AS delay_us FROM j""")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event of the first type with the next one of the last type by the same subject, as a beat finds its pulse."""
    e = events(spark, sf_dir)
    ends = e.agg(F.min("event_type").alias("first"), F.max("event_type").alias("last"))
    e = e.crossJoin(F.broadcast(ends))  # one row
    left = e.where("event_type = first").select("event_id", "user_id", "ts")
    right = e.where("event_type = last").select("user_id", "ts", F.col("ts").alias("next"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return J.asof_forward(left, right, ["user_id"], "ts", "next").select("event_id", "user_id", F.coalesce(us("next") - us("ts"), F.lit(-1)).alias("delay_us"))


@query(f"""WITH m AS (SELECT user_id, avg(value) AS m, count(*) AS n FROM events GROUP BY 1)
SELECT event_id, {r6('value - m', 'centred', 9)}, n FROM events JOIN m USING (user_id)""")
def subject_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "value")
    n = e.groupBy("user_id").agg(F.count("*").alias("n"))
    return rounded(T.centre_by(e, "user_id", ["value"]).join(n, "user_id").select("event_id", F.col("value").alias("centred"), "n"), ["event_id"], 9)


@query("""WITH o AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, k > greatest(floor(n * 0.75::DOUBLE), 1) AS test FROM o""")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.temporal(events(spark, sf_dir), "user_id", "ts", key="event_id").select("event_id", "test")


@query("""WITH u AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1)::INTEGER AS fold FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 8))
SELECT event_id, coalesce(fold, -1)::INTEGER AS fold FROM events LEFT JOIN u USING (user_id)""")
def leave_one_subject_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leave_one_out(events(spark, sf_dir), "user_id").select("event_id", F.coalesce("fold", F.lit(-1)).alias("fold"))


@query("""WITH m AS (SELECT coalesce(max(event_id), -1) + 1 AS n FROM events), b AS (SELECT k AS fold, k * n // 5 AS a, (k + 1) * n // 5 AS z FROM m, range(0, 5) r(k))
SELECT fold::INTEGER AS fold, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events JOIN b ON event_id >= a AND event_id < z GROUP BY 1""")
def fold_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five equal ranges up to the last event, so that every event is in a fold."""
    e = events(spark, sf_dir)
    n = e.agg((F.coalesce(F.max("event_id"), F.lit(-1)) + 1).alias("n")).first()["n"]
    found = S.contiguous(e, S.equal_parts(n, 5), "event_id")
    return found.groupBy("fold").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


@query("""SELECT CASE WHEN b = 60 THEN 59 ELSE floor(b) END::INTEGER AS k, count(*) AS n FROM (SELECT (value - (-1)) / 2 AS b FROM events) WHERE b BETWEEN 0 AND 60 GROUP BY 1""")
def target_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.histogram(events(spark, sf_dir), "value", 0.0, 2.0, 60)


ROBUST = {c: f"greatest(quantile_cont({c}, 0.005) OVER (), least(CASE WHEN quantile_cont({c}, 0.995) OVER () > quantile_cont({c}, 0.005) OVER () THEN quantile_cont({c}, 0.995) OVER () ELSE quantile_cont({c}, 0.005) OVER () + 1 END, {c}))" for c in FEATURES[:3]}


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{sql} AS {c}' for c, sql in ROBUST.items())} FROM lineitem)
SELECT l_orderkey, l_linenumber, {', '.join(r6(f'({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-9::DOUBLE)', c) for c in ROBUST)} FROM c""")
def winsor_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES[:3])
    return rounded(T.fit_robust(li, FEATURES[:3]).apply(li), ["l_orderkey", "l_linenumber"])


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 < 2 THEN l_extendedprice END AS v FROM lineitem),
i AS (SELECT l_orderkey, l_linenumber, coalesce(v, (SELECT median(v) FROM h))::DOUBLE AS v FROM h), q AS (SELECT quantile_cont(v, 0.005) AS a, quantile_cont(v, 0.995) AS b FROM i),
c AS (SELECT l_orderkey, l_linenumber, greatest(a, least(b, v)) AS v FROM i, q)
SELECT l_orderkey, l_linenumber, {r6('(v - avg(v) OVER ()) / (stddev_pop(v) OVER () + 1e-9::DOUBLE)', 'price')} FROM c""")
def winsor_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three fifths of the values are missing: percentiles are those of the imputed column."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 5 < 2, F.col("l_extendedprice")).alias("price"))
    return rounded(T.fit_robust(li, ["price"]).apply(li), ["l_orderkey", "l_linenumber"])


@query(f"""WITH h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity END AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, {r6('coalesce(q, (SELECT median(q) FROM h))', 'l_quantity')} FROM h""")
def impute_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column with holes is imputed; one that is constant is dropped."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity")).alias("l_quantity"), F.lit(1.0).alias("constant"))
    fitted = T.fit_robust(li, ["l_quantity", "constant"], tails=(0.0, 1.0))
    return rounded(fitted.clipped(li), ["l_orderkey", "l_linenumber"])


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, round(abs(corr({c}, l_extendedprice)), 6) AS size FROM lineitem" for c in FEATURES) + ") SELECT * FROM c ORDER BY size DESC LIMIT 3")
def correlation_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in T.target_correlations(li, FEATURES, "l_extendedprice")[:3]], "name string, size double")


@query(f"""WITH k AS (SELECT quantile_cont(l_quantity, [0.02, 0.14, 0.26, 0.38, 0.5, 0.62, 0.74, 0.86, 0.98]) AS k FROM lineitem),
b AS (SELECT DISTINCT l_quantity, unnest(k)::DOUBLE AS c, generate_subscripts(k, 1) - 1 AS pos, (k[9] - k[1]) / 8 AS s FROM lineitem, k), e AS (SELECT *, exp(-0.5::DOUBLE * ((l_quantity - c) / s) ^ 2) AS e FROM b)
SELECT l_quantity, pos::INTEGER AS pos, {r6('e / (sum(e) OVER (PARTITION BY l_quantity) + 1e-9::DOUBLE)', 'bump')} FROM e""")
def bump_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    knots = T.fit_knots(li, ["l_quantity"])["l_quantity"]
    values = li.select("l_quantity").distinct()
    return rounded(values.select("l_quantity", F.posexplode(A.bumps(F.col("l_quantity"), A.constant(knots))).alias("pos", "bump")), ["l_quantity", "pos"])


@query(f"""WITH g AS (SELECT DISTINCT l_discount, l_tax FROM lineitem), b AS (SELECT *, k AS i, exp(-0.5::DOUBLE * ((l_discount - k * 0.025::DOUBLE) / 0.025::DOUBLE) ^ 2) AS u FROM g, range(0, 5) r(k)),
bn AS (SELECT *, u / (sum(u) OVER (PARTITION BY l_discount, l_tax) + 1e-9::DOUBLE) AS un FROM b),
c AS (SELECT *, k AS j, exp(-0.5::DOUBLE * ((l_tax - k * 0.04::DOUBLE) / 0.04::DOUBLE) ^ 2) AS v FROM g, range(0, 3) r(k)), cn AS (SELECT *, v / (sum(v) OVER (PARTITION BY l_discount, l_tax) + 1e-9::DOUBLE) AS vn FROM c)
SELECT l_discount, l_tax, (i * 3 + j)::INTEGER AS pos, {r6('un * vn', 'value')} FROM bn JOIN cn USING (l_discount, l_tax)""")
def tensor_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").select("l_discount", "l_tax").distinct()
    one, two = A.constant([k * 0.025 for k in range(5)]), A.constant([k * 0.04 for k in range(3)])
    both = A.outer(A.bumps(F.col("l_discount"), one), A.bumps(F.col("l_tax"), two))
    return rounded(g.select("l_discount", "l_tax", F.posexplode(both).alias("pos", "value")), ["l_discount", "l_tax", "pos"])


@query(f"SELECT l_orderkey, l_linenumber, pos, bump FROM lineitem JOIN ({ORACLE_SQL['bump_basis']}) USING (l_quantity)")
def bump_basis_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bump_basis, of each row of lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    knots = T.fit_knots(li, ["l_quantity"])["l_quantity"]
    bumps = T.expand_bumps(li, "l_quantity", knots, "b")
    found = bumps.select("l_orderkey", "l_linenumber", F.posexplode(F.array(*[f"b{k}" for k in range(len(knots))])).alias("pos", "bump"))
    return rounded(found, ["l_orderkey", "l_linenumber", "pos"])


@query(f"SELECT l_orderkey, l_linenumber, pos, value FROM lineitem JOIN ({ORACLE_SQL['tensor_basis']}) USING (l_discount, l_tax)")
def tensor_basis_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As tensor_basis, of each row of lineitem."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    bumps = T.expand_bumps(T.expand_bumps(li, "l_discount", [k * 0.025 for k in range(5)], "u"), "l_tax", [k * 0.04 for k in range(3)], "v")
    products = F.array(*[F.col(f"u{i}") * F.col(f"v{j}") for i in range(5) for j in range(3)])
    found = bumps.select("l_orderkey", "l_linenumber", F.posexplode(products).alias("pos", "value"))
    return rounded(found, ["l_orderkey", "l_linenumber", "pos"])


_Z = ["1", *[f"{c}::DOUBLE" for c in FEATURES], "l_extendedprice / 1000"]


@query("SELECT (l_orderkey % 5)::INTEGER AS fold, " + ", ".join(r6(f"avg({_Z[i]} * {_Z[j]})", f"g{i}_{j}", 4) for i in range(6) for j in range(i, 6)) + " FROM lineitem GROUP BY 1")
def fold_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal equations of each fold, over its rows."""
    rows = []
    for fold, n in G.normal_equations(design(spark, sf_dir), len(FEATURES), fold="fold").items():
        full = np.vstack([np.column_stack([n.gram, n.moment]), np.append(n.moment, n.squares)]) / n.weight
        rows.append((fold, *[round(float(full[i, j]), 4) for i in range(6) for j in range(i, 6)]))
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"g{i}_{j} double" for i in range(6) for j in range(i, 6)))


@query(f"SELECT {r6('regr_intercept(l_extendedprice, l_quantity)', 'intercept', 3)}, {r6('regr_slope(l_extendedprice, l_quantity)', 'slope', 3)} FROM lineitem")
def ols_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("x"), F.col("l_extendedprice").alias("y"))
    m = L.ols(G.normal_equations(li, 1)[0])
    return spark.createDataFrame([(round(m.intercept, 3), round(float(m.coef[0]), 3))], "intercept double, slope double")


_NM = "sum(abs(y - p)) / sum(abs(y - m))", "sum((y - p) ^ 2) / sum((y - m) ^ 2)"


@query(f"""WITH t AS (SELECT l_returnflag, l_extendedprice AS y, 1500 * l_quantity::DOUBLE AS p FROM lineitem), a AS (SELECT *, avg(y) OVER (PARTITION BY l_returnflag) AS m FROM t)
SELECT l_returnflag, {r6(_NM[0], 'nmae')}, {r6(_NM[1], 'nmse')}, count(*) AS n FROM a GROUP BY 1""")
def nmae_nmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return rounded(M.scores(li, "l_extendedprice", "p", ["l_returnflag"]), ["l_returnflag"])


@query(f"""WITH t AS (SELECT l_extendedprice AS y, (SELECT median(l_extendedprice) FROM lineitem WHERE l_orderkey % 5 > 0) AS p FROM lineitem WHERE l_orderkey % 5 = 0), a AS (SELECT *, avg(y) OVER () AS m FROM t)
SELECT {r6(_NM[0], 'nmae')}, {r6(_NM[1], 'nmse')}, count(*) AS n FROM a""")
def median_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return rounded(M.median_baseline(li.where("l_orderkey % 5 > 0"), li.where("l_orderkey % 5 = 0"), "l_extendedprice"), [])


#: A weight for each feature and return flag: the slope of the price against the feature.
WEIGHTS_SQL = "w AS (" + " UNION ALL ".join(
    f"SELECT l_returnflag AS block, '{c}' AS name, regr_slope(l_extendedprice, {c}) / 1000 AS weight FROM lineitem GROUP BY 1" for c in FEATURES
) + "), i AS (SELECT row_number() OVER (ORDER BY block, name)::INTEGER AS index, * FROM w)"


def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, block, name, weight: for each return flag the slope of the price against each feature, alone."""
    li = table(spark, sf_dir, "lineitem")
    wide = li.groupBy("l_returnflag").agg(*[F.regr_slope("l_extendedprice", c).alias(c) for c in FEATURES])
    long = wide.select(F.col("l_returnflag").alias("block"), F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) / 1000).alias("weight")) for c in FEATURES])).alias("w"))
    return long.select(F.row_number().over(W.orderBy("block", "w.name")).alias("index"), "block", "w.name", "w.weight")  # a row a flag and feature


@query(f"""WITH {WEIGHTS_SQL}, g AS (SELECT name AS "group", sum(abs(weight)) AS total FROM i GROUP BY 1)
SELECT "group", {r6('total', 'total')}, row_number() OVER (ORDER BY total DESC, "group")::INTEGER AS rank FROM g""")
def weight_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SEL.grouped_weights(feature_weights(spark, sf_dir), F.col("name"))
    return rounded(found.withColumn("rank", F.row_number().over(W.orderBy(F.desc("total"), "group"))), ["group"])  # a row a group


@query(f"""WITH {WEIGHTS_SQL} SELECT block, count(*) AS columns, {r6('sum(abs(weight))', 'total')}, {r6('avg(abs(weight))', 'mean')}, {r6('max(abs(weight))', 'largest')},
{r6('sum(abs(weight)) / (SELECT sum(abs(weight)) FROM i)', 'share')} FROM i GROUP BY 1""")
def weight_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(SEL.weights_table(feature_weights(spark, sf_dir)), ["block"])


@query(f"WITH {WEIGHTS_SQL} SELECT index, block, name, {r6('weight', 'weight')} FROM i ORDER BY abs(weight) DESC, index LIMIT 5")
def largest_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the five largest."""
    return rounded(SEL.largest_weights(feature_weights(spark, sf_dir), 5), ["index", "block", "name"])


@query(f"""SELECT l_orderkey, l_linenumber, {r6('l_extendedprice', 'price')}, {r6('abs(l_extendedprice - (SELECT median(l_extendedprice) FROM lineitem))', 'distance')} FROM lineitem
WHERE l_quantity > 10 ORDER BY abs(l_extendedprice - (SELECT median(l_extendedprice) FROM lineitem)), l_orderkey, l_linenumber LIMIT 1""")
def representative_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row nearest the median of the target among those of good quality."""
    li = table(spark, sf_dir, "lineitem")
    middle = median(li, F.col("l_extendedprice"))
    near = li.where("l_quantity > 10").withColumn("distance", F.abs(F.col("l_extendedprice") - F.lit(middle)))
    top = near.orderBy("distance", "l_orderkey", "l_linenumber").limit(1)
    return rounded(top.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"), "distance"), ["l_orderkey", "l_linenumber"])


@query("""WITH o AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > 1800000000) AS sessions FROM o GROUP BY 1""")
def subject_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = us("ts") - us("_previous")
    e = J.previous(events(spark, sf_dir), "user_id", "ts", "event_id").select("user_id", (gap.isNull() | (gap > 1_800_000_000)).alias("new"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("new").alias("sessions"))


def standard_design(spark: SparkSession, sf_dir: str, names: list[str] = FEATURES, epsilon: float = 1e-8) -> DataFrame:
    """The design of lineitem with columns less their mean and over their deviation plus epsilon."""
    rows = design(spark, sf_dir).withColumn("x", F.array(*[F.get("x", F.lit(FEATURES.index(c))) for c in names]))
    everything = G.normal_equations(rows, len(names))[0]
    gram, _, mean, _ = L.centred(everything)
    scale = np.sqrt(np.diag(gram) / everything.weight) + epsilon
    at = [((F.get("x", F.lit(k)) - float(m)) / float(s)) for k, (m, s) in enumerate(zip(mean, scale, strict=True))]
    return rows.withColumn("x", F.array(*at))


#: Sums (n, sx, sy, sxx, sxy, syy) of l_quantity and the price in thousands, by fold and of all rows.
ONE_SQL = """d AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
f AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY 1),
a AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy, sum(syy) AS syy FROM f)"""
ONE_LAMBDAS = [0.0, 0.1, 10.0, 1000.0, 100000.0]


def one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir).withColumn("x", F.array(F.get("x", F.lit(0))))


@query(f"""WITH {ONE_SQL}, l AS (SELECT unnest({ONE_LAMBDAS})::DOUBLE AS penalty),
t AS (SELECT fold, penalty, a.n - f.n AS n, a.sx - f.sx AS sx, a.sy - f.sy AS sy, a.sxx - f.sxx AS sxx, a.sxy - f.sxy AS sxy FROM f, a, l),
m AS (SELECT fold, penalty, (sxy - sx * sy / n) / (sxx - sx * sx / n + penalty) AS w, sx, sy, n FROM t), c AS (SELECT fold, penalty, w, (sy - w * sx) / n AS b FROM m),
e AS (SELECT penalty, avg((syy - 2 * b * sy - 2 * w * sxy + n * b * b + 2 * b * w * sx + w * w * sxx) / (syy - sy * sy / n)) AS nmse FROM c JOIN f USING (fold) GROUP BY 1)
SELECT penalty, {r6('nmse', 'nmse', 8)}, penalty = (SELECT min_by(penalty, nmse) FROM e) AS best FROM e""")
def ridge_cv_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, best, _ = L.ridge_cv(one_column(spark, sf_dir), 1, ONE_LAMBDAS)
    return spark.createDataFrame([(lam, round(e, 8), k == best) for k, (lam, e) in enumerate(zip(ONE_LAMBDAS, errors, strict=True))], "penalty double, nmse double, best boolean")


@query(f"""WITH {ONE_SQL}, l AS (SELECT unnest([0.1, 10, 1000, 100000])::DOUBLE AS penalty), m AS (SELECT penalty, n, sx / n AS mx, sy / n AS my, sxx - sx * sx / n AS q, (sxy - sx * sy / n) / (sxx - sx * sx / n + penalty) AS w FROM a, l)
SELECT penalty, {r6('avg(((y - my - w * (x - mx)) / (1 - (x - mx) ^ 2 / (q + penalty) - 1 / n)) ^ 2)', 'mse', 8)} FROM d, m GROUP BY penalty""")
def ridge_leave_one_out_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, lambdas = one_column(spark, sf_dir), [0.1, 10.0, 1000.0, 100000.0]
    found = L.leave_one_out(rows, G.normal_equations(rows, 1)[0], lambdas)
    return spark.createDataFrame([(lam, round(float(e), 8)) for lam, e in zip(lambdas, found, strict=True)], "penalty double, mse double")


NET_ALPHAS, NET_RATIOS = [float(v) for v in np.logspace(-2, 2, 50)], [0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]


@query(f"""WITH {ONE_SQL}, p AS (SELECT alpha, ratio FROM (SELECT unnest({NET_ALPHAS})::DOUBLE AS alpha), (SELECT unnest({NET_RATIOS})::DOUBLE AS ratio)),
m AS (SELECT alpha, ratio, sxy / n - sx * sy / n / n AS c, sxx / n - sx * sx / n / n AS v, sx / n AS mx, sy / n AS my FROM a, p),
w AS (SELECT alpha, ratio, mx, my, sign(c) * greatest(abs(c) - alpha * ratio, 0) / (v + alpha * (1 - ratio)) AS w FROM m)
SELECT {r6('alpha', 'alpha')}, ratio, {r6('w', 'slope')}, {r6('my - w * mx', 'intercept')} FROM w""")
def elastic_net_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full grid of penalties and ratios, from one set of sums."""
    normal = G.normal_equations(one_column(spark, sf_dir), 1)[0]
    found = [(a, r, L.elastic_net(normal, a, r)) for a in NET_ALPHAS for r in NET_RATIOS]
    return rounded(spark.createDataFrame([(a, r, float(m.coef[0]), float(m.intercept)) for a, r, m in found], "alpha double, ratio double, slope double, intercept double"), [])


@query(f"""WITH {ONE_SQL}, z AS (SELECT fold, y, (x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-8::DOUBLE) AS x, avg(y) OVER () AS m FROM d),
s AS (SELECT sum(x * (y - m)) / (sum(x * x) + 10) AS w FROM z), r AS (SELECT z.*, y - m - w * x AS r FROM z, s), q AS (SELECT median(r) AS q FROM r),
g AS (SELECT 1.345::DOUBLE * median(abs(r - q)) + 1e-3::DOUBLE AS g FROM r, q), v AS (SELECT r.*, 1 / greatest(abs(r), g) AS v FROM r, g),
t AS (SELECT sum(v * x * (y - m)) / (sum(v * x * x) + 10 * avg(v)) AS w FROM v), h AS (SELECT y, m, x, avg(y) OVER () AS hm FROM z WHERE fold = 0),
e AS (SELECT sum(abs(y - m - s.w * x)) / sum(abs(y - hm)) AS plain, sum(abs(y - m - t.w * x)) / sum(abs(y - hm)) AS bent FROM h, s, t)
SELECT {r6('plain', 'plain_nmae')}, {r6('CASE WHEN bent < plain THEN bent ELSE plain END', 'nmae')}, {r6('CASE WHEN bent < plain THEN t.w ELSE s.w END', 'slope')}, {r6('any_value(m)', 'intercept')}
FROM e, s, t, h GROUP BY ALL""")
def reweighted_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round towards least absolute errors, scored on the fold held out."""
    rows = standard_design(spark, sf_dir, FEATURES[:1]).persist()
    gram, moment, level = L.about_mean(G.normal_equations(rows, 1)[0])
    start, held = L.Linear(level, moment / (gram[0] + 10)), F.col("fold") == 0
    m = L.irls(rows, 1, 10.0, start, rounds=1, held=held)
    (plain, _), (best, _) = L.scored(rows.where(held), [start, m])
    rows.unpersist()
    return rounded(spark.createDataFrame([(plain, best, float(m.coef[0]), float(m.intercept))], "plain_nmae double, nmae double, slope double, intercept double"), [])


ABLATION = [("first", (1.0, SEL.OFF)), ("second", (SEL.OFF, 1.0)), ("both", (1.0, 1.0)), ("preset", (0.1, 10.0))]
ABLATION_LAMBDAS = [0.1, 10.0, 1000.0, 100000.0]
_CONFIGS = ", ".join(f"('{name}', {a}::DOUBLE, {b}::DOUBLE)" for name, (a, b) in ABLATION)


@query(f"""WITH d AS (SELECT l_orderkey % 5 = 0 AS held, l_quantity::DOUBLE AS u, l_tax::DOUBLE AS v, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
z AS (SELECT held, y, (u - avg(u) OVER ()) / (stddev_pop(u) OVER () + 1e-8::DOUBLE) AS u, (v - avg(v) OVER ()) / (stddev_pop(v) OVER () + 1e-8::DOUBLE) AS v FROM d),
m AS (SELECT avg(y) AS m FROM z WHERE NOT held), g AS (SELECT sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * (y - m)) AS uy, sum(v * (y - m)) AS vy FROM z, m WHERE NOT held),
c(config, a, b) AS (VALUES {_CONFIGS}), l AS (SELECT unnest({ABLATION_LAMBDAS})::DOUBLE AS penalty),
w AS (SELECT config, penalty, ((vv + penalty * b) * uy - uv * vy) / ((uu + penalty * a) * (vv + penalty * b) - uv * uv) AS p, ((uu + penalty * a) * vy - uv * uy) / ((uu + penalty * a) * (vv + penalty * b) - uv * uv) AS q FROM g, c, l),
h AS (SELECT y, u, v, avg(y) OVER () AS hm FROM z WHERE held), e AS (SELECT config, penalty, sum(abs(y - m - p * u - q * v)) / sum(abs(y - hm)) AS nmae FROM h, w, m GROUP BY 1, 2)
SELECT config, {r6('min(nmae)', 'nmae')}, min_by(penalty, nmae) AS penalty FROM e GROUP BY 1""")
def block_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks of a column each, taken out by a penalty in turn: held-out error and penalty of each configuration."""
    rows = standard_design(spark, sf_dir, [FEATURES[0], FEATURES[2]]).persist()
    held = F.col("fold") == 0
    found = SEL.ablation(G.normal_equations(rows.where(~held), 2)[0], rows.where(held), np.array([0, 1]), ABLATION, ABLATION_LAMBDAS)
    rows.unpersist()
    return rounded(spark.createDataFrame(found, "config string, nmae double, penalty double"), ["config"])


@query()
def column_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of embeddings against their label: held-out error of the first k columns by weight, for rising k."""
    rows = table(spark, sf_dir, "embeddings").select(A.doubles(F.col("embedding")).alias("x"), F.col("label").cast("double").alias("y"), (F.col("vec_id") % 4 == 3).alias("held")).persist()
    _, found = SEL.sweep(G.normal_equations(rows.where("NOT held"), 64)[0], rows.where("held"), np.ones(64), L.LAMBDAS_D, (2, 4, 8, 16, 32, 48))
    rows.unpersist()
    return rounded(spark.createDataFrame(found, "k int, nmae double, penalty double"), ["k"])


@query(f"""WITH o AS (SELECT l_orderkey, l_linenumber, (l_quantity::DOUBLE - (SELECT avg(l_quantity) FROM lineitem)) / ((SELECT stddev_pop(l_quantity) FROM lineitem) + 1e-8::DOUBLE) AS x, l_extendedprice::DOUBLE / 1000 AS y,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS id, count(*) OVER () AS n FROM lineitem),
k AS (SELECT *, CASE WHEN id < n * 1 // 5 THEN 0 WHEN id < n * 2 // 5 THEN 1 WHEN id < n * 3 // 5 THEN 2 WHEN id < n * 4 // 5 THEN 3 ELSE 4 END AS fold FROM o), b AS (SELECT unnest(range(0, 5)) AS held),
t AS (SELECT held, avg(y) AS m, median(y) AS q FROM k, b WHERE fold <> held GROUP BY 1), w AS (SELECT held, sum(x * (y - m)) / (sum(x * x) + 10) AS w FROM k JOIN t ON fold <> held GROUP BY 1),
p AS (SELECT fold, y, m + w * x AS p, q FROM k JOIN t ON fold = t.held JOIN w ON fold = w.held), f AS (SELECT *, avg(y) OVER (PARTITION BY fold) AS fm, avg(y) OVER () AS am FROM p),
r AS (SELECT (fold + 1)::VARCHAR AS fold, sum(abs(y - p)) / sum(abs(y - fm)) AS nmae, sum((y - p) ^ 2) / sum((y - fm) ^ 2) AS nmse, sum(abs(y - q)) / sum(abs(y - fm)) AS median_nmae, sum((y - q) ^ 2) / sum((y - fm) ^ 2) AS median_nmse, any_value(q) AS median FROM f GROUP BY fold),
u AS (SELECT * FROM r UNION ALL SELECT 'mean', avg(nmae), avg(nmse), avg(median_nmae), avg(median_nmse), avg(median) FROM r
UNION ALL SELECT 'std', stddev_pop(nmae), stddev_pop(nmse), stddev_pop(median_nmae), stddev_pop(median_nmse), stddev_pop(median) FROM r
UNION ALL SELECT 'pooled', sum(abs(y - p)) / sum(abs(y - am)), sum((y - p) ^ 2) / sum((y - am) ^ 2), sum(abs(y - q)) / sum(abs(y - am)), sum((y - q) ^ 2) / sum((y - am) ^ 2), NULL FROM f)
SELECT fold, {', '.join(r6(c, c) for c in ('nmae', 'nmse', 'median_nmae', 'median_nmse', 'median'))} FROM u""")
def cross_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five contiguous folds of all lines in order: out-of-fold scores of a ridge of one column, and of the median."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("y"))
    placed = J.place_in_order(li.withColumn("all", F.lit(0)), "all", "l_orderkey", "l_linenumber")
    about = li.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"), F.count("*").alias("n")).first()
    x = F.array((F.col("l_quantity") - about["m"]) / (about["s"] + 1e-8))
    rows = placed.select((F.col("_place") - 1).alias("row_id"), x.alias("x"), "y")
    found = durable(SEL.cross_validated(rows, about["n"], 1, np.zeros(1, int), [(1.0,)], [10.0], rounds=0, clip=False))
    return rounded(SEL.cross_validation_table(found), ["fold"])


KNOTS_AT = [0.0, 0.005, 0.25, 0.5, 0.7, 0.995, 1.0]


@query("WITH q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, unnest({KNOTS_AT}) AS share, unnest(quantile_cont({c}::DOUBLE, {KNOTS_AT})) AS value FROM lineitem" for c in [*FEATURES, "l_extendedprice"])
       + f") SELECT name, share::DOUBLE AS share, {r6('value', 'value')} FROM q")
def column_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quantiles of several columns, in a few passes and without a sort."""
    names = [*FEATURES, "l_extendedprice"]
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), {c: F.col(c) for c in names}, KNOTS_AT)
    rows = [(c, q, v) for c in names for q, v in zip(KNOTS_AT, found[c], strict=True)]
    return rounded(spark.createDataFrame(rows, "name string, share double, value double"), ["name", "share"])


@query(f"SELECT l_orderkey, l_linenumber, {', '.join(r6(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()', c) for c in FEATURES[:3])} FROM lineitem")
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *FEATURES[:3])
    return rounded(T.fit_standard(li, FEATURES[:3]).apply(li), ["l_orderkey", "l_linenumber"])


_BENT = "CASE WHEN v >= 0 THEN CASE WHEN l = 0 THEN ln(1 + v) ELSE ((v + 1) ^ l - 1) / l END ELSE CASE WHEN l = 2 THEN -ln(1 - v) ELSE -((1 - v) ^ (2 - l) - 1) / (2 - l) END END"
POWER_GRID = [-1.0, 0.0, 0.5, 1.0, 2.0, 3.0]


@query("WITH v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS v FROM lineitem" for c in FEATURES) + f"""), l AS (SELECT unnest({POWER_GRID})::DOUBLE AS l),
b AS (SELECT name, l, v, {_BENT} AS t FROM v, l)
SELECT name, l AS power, {r6('-0.5::DOUBLE * ln(var_pop(t)) + (l - 1) * avg(sign(v) * ln(1 + abs(v)))', 'likelihood')} FROM b GROUP BY 1, 2""")
def power_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean log likelihood of Yeo-Johnson parameters, which the search compares."""
    found = T.power_likelihoods(table(spark, sf_dir, "lineitem"), {c: np.array(POWER_GRID) for c in FEATURES})
    rows = [(c, lam, float(v)) for c in FEATURES for lam, v in zip(POWER_GRID, found[c], strict=True)]
    return rounded(spark.createDataFrame(rows, "name string, power double, likelihood double"), ["name", "power"])


#: Rows as lists of the four columns and the target.
LIST_SQL = "z AS (SELECT (l_orderkey % 5)::INTEGER AS fold, [" + ", ".join(f"{c}::DOUBLE" for c in FEATURES) + ", l_extendedprice::DOUBLE / 1000] AS v FROM lineitem)"
_CELL = "m[(x // 5) * 5 + k + 1]"


def swept_sql(start: str, keys: str) -> str:
    """Tables sw and w: the matrices (keys, m: four rows of four columns and the right side) of the table start, swept by one
    column after another, after which the first columns hold the inverse and the last one the solution."""
    return f"""sw AS (SELECT {keys}, 0 AS k, m FROM {start} UNION ALL SELECT {keys}, k + 1, list_transform(range(0, 20), lambda x: CASE
  WHEN x // 5 = k AND x % 5 = k THEN 1 / m[k * 6 + 1] WHEN x // 5 = k THEN m[x + 1] / m[k * 6 + 1] WHEN x % 5 = k THEN -m[x + 1] / m[k * 6 + 1]
  ELSE m[x + 1] - {_CELL} * m[k * 5 + x % 5 + 1] / m[k * 6 + 1] END) FROM sw WHERE k < 4),
w AS (SELECT {keys}, m, [m[5], m[10], m[15], m[20]] AS w FROM sw WHERE k = 4)"""


FOUR_LAMBDAS = [0.0, 0.1, 10.0, 1000.0]


@query(f"""WITH RECURSIVE {LIST_SQL}, l AS (SELECT unnest({FOUR_LAMBDAS})::DOUBLE AS penalty), h AS (SELECT unnest(range(0, 5))::INTEGER AS held),
ij AS (SELECT unnest(range(1, 5)) AS i), jj AS (SELECT unnest(range(1, 6)) AS j),
c AS (SELECT held, i, j, covar_pop(v[i], v[j]) * count(*) AS c FROM z JOIN h ON fold <> held, ij, jj GROUP BY 1, 2, 3), a AS (SELECT held, list(a ORDER BY j) AS a FROM (SELECT held, j, avg(v[j]) AS a FROM z JOIN h ON fold <> held, jj GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT held, penalty, list(c + CASE WHEN i = j THEN penalty ELSE 0 END ORDER BY i, j) AS m FROM c, l GROUP BY 1, 2), {swept_sql('t', 'held, penalty')},
e AS (SELECT held, penalty, sum((v[5] - a[5] - w[1] * (v[1] - a[1]) - w[2] * (v[2] - a[2]) - w[3] * (v[3] - a[3]) - w[4] * (v[4] - a[4])) ^ 2) / (var_pop(v[5]) * count(*)) AS e
  FROM z JOIN w ON fold = held JOIN a USING (held) GROUP BY 1, 2), s AS (SELECT penalty, avg(e) AS nmse FROM e GROUP BY 1)
SELECT penalty AS lambda, {r6('nmse', 'nmse', 8)}, penalty = (SELECT min_by(penalty, nmse) FROM s) AS best FROM s""")
def ridge_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors, best, _ = L.ridge_cv(design(spark, sf_dir), 4, FOUR_LAMBDAS)
    return spark.createDataFrame([(lam, round(e, 8), k == best) for k, (lam, e) in enumerate(zip(FOUR_LAMBDAS, errors, strict=True))], "lambda double, nmse double, best boolean")


@query()
def block_ridge_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block ridge of standardised columns, reweighted towards least absolute errors, scored on the rows that were held out."""
    rows = durable(standard_design(spark, sf_dir))
    m = L.block_ridge(rows, 4, np.array([0, 0, 1, 1]), [(0.1, 1.0), (1.0, 1.0), (0.03, 0.3), (0.01, 30.0)], L.LAMBDAS_C, F.col("fold") == 0)
    return M.scores(rows.where("fold = 0").withColumn("p", m.predict()), "y", "p")


@query()
def elastic_net_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = G.normal_equations(design(spark, sf_dir), 4, fold="fold")
    alpha, ratio, m = L.elastic_net_cv(parts, np.logspace(-2, 2, 50), (0.1, 0.3, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0))
    return spark.createDataFrame([(float(alpha), float(ratio), float(m.intercept), [float(c) for c in m.coef])], "alpha double, l1_ratio double, intercept double, coef array<double>")


@query(f"""WITH RECURSIVE {LIST_SQL}, l AS (SELECT unnest({list(SEARCH.PENALTIES)})::DOUBLE AS penalty), ij AS (SELECT unnest(range(1, 5)) AS i), jj AS (SELECT unnest(range(1, 6)) AS j),
c AS (SELECT i, j, covar_pop(v[i], v[j]) * count(*) AS c FROM z, ij, jj GROUP BY 1, 2), a AS (SELECT list(a ORDER BY j) AS a, any_value(n) AS n FROM (SELECT j, avg(v[j]) AS a, count(*) AS n FROM z, jj GROUP BY 1)),
t AS (SELECT penalty, list(c + CASE WHEN i = j THEN penalty ELSE 0 END ORDER BY i, j) AS m FROM c, l GROUP BY 1), {swept_sql('t', 'penalty')},
d AS (SELECT v[5] - a[5] AS y, [v[1] - a[1], v[2] - a[2], v[3] - a[3], v[4] - a[4]] AS x, n FROM z, a),
e AS (SELECT penalty, avg(((y - list_dot_product(w, x)) / (1 - list_dot_product(x, [list_dot_product(m[1:4], x), list_dot_product(m[6:9], x), list_dot_product(m[11:14], x), list_dot_product(m[16:19], x)]) - 1 / n)) ^ 2) AS e FROM d, w GROUP BY 1)
SELECT penalty AS lambda, {r6('e', 'mse', 7)} FROM e""")
def ridge_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = design(spark, sf_dir)
    found = L.leave_one_out(rows, G.normal_equations(rows, 4)[0], SEARCH.PENALTIES)
    return rounded(spark.createDataFrame([(float(lam), float(e)) for lam, e in zip(SEARCH.PENALTIES, found, strict=True)], "lambda double, mse double"), ["lambda"], 7)


FOLD_PENALTIES = np.logspace(-3, 3, 25).tolist()


@query(f"""WITH {ONE_SQL}, l AS (SELECT unnest({FOLD_PENALTIES})::DOUBLE AS penalty),
s AS (SELECT sx / n AS m, sqrt(sxx / n - (sx / n) ^ 2) AS s FROM a), z AS (SELECT fold, (x - m) / s AS x, y FROM d, s),
g AS (SELECT fold, count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM z GROUP BY 1), h AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM g),
t AS (SELECT fold, penalty, h.n - g.n AS n, h.sx - g.sx AS sx, h.sy - g.sy AS sy, h.sxx - g.sxx AS sxx, h.sxy - g.sxy AS sxy FROM g, h, l),
m AS (SELECT fold, penalty, (sxy - sx * sy / n) / (sxx - sx * sx / n + penalty) AS w, sx, sy, n FROM t), c AS (SELECT fold, penalty, w, (sy - w * sx) / n AS b FROM m),
e AS (SELECT penalty, avg((syy - 2 * b * sy - 2 * w * sxy + n * b * b + 2 * b * w * sx + w * w * sxx) / (syy - sy * sy / n)) AS nmse FROM c JOIN g USING (fold) GROUP BY 1)
SELECT penalty, {r6('nmse', 'nmse', 9)} FROM e""")
def ridge_folds_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors over five folds of a standardised column, for each of 25 penalties."""
    errors, _, _ = L.ridge_cv(standard_design(spark, sf_dir, FEATURES[:1], 0.0), 1, FOLD_PENALTIES)
    return rounded(spark.createDataFrame(list(zip(FOLD_PENALTIES, errors, strict=True)), "penalty double, nmse double"), ["penalty"], 9)


#: A column between -1 and 1, as a correlation is, and a second one that passes.
GATED_SQL = "g AS (SELECT (l_orderkey % 5)::INTEGER AS fold, (l_quantity::DOUBLE - 25.5::DOUBLE) / 24.5::DOUBLE AS c, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem)"


def gated_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir).withColumn("x", F.transform("x", lambda v, k: F.when(k == 0, (v - 25.5) / 24.5).otherwise(v)))


_PER = "PARTITION BY strength, t.fold"


@query(f"""WITH {GATED_SQL}, s AS (SELECT unnest({list(SEARCH.STRENGTHS)})::DOUBLE AS strength), l AS (SELECT unnest({list(SEARCH.PENALTIES)})::DOUBLE AS penalty),
d AS (SELECT strength, fold, c * (1 + 0.6::DOUBLE * tanh(12 * (abs(c) - strength))) AS x, y FROM g, s),
f AS (SELECT DISTINCT fold FROM g UNION ALL SELECT -1),
m AS (SELECT strength, f.fold, count(*)::DOUBLE AS n, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) * count(*) AS sxy FROM d JOIN f ON d.fold <> f.fold GROUP BY 1, 2),
w AS (SELECT *, sxy / (n + penalty) AS w FROM m, l),
e AS (SELECT w.strength, w.fold, penalty, avg(((d.y - my - w * (x - mx) / sx) / (1 - ((x - mx) / sx) ^ 2 / (n + penalty) - 1 / n)) ^ 2) AS e FROM d JOIN w ON d.strength = w.strength AND d.fold <> w.fold GROUP BY 1, 2, 3),
b AS (SELECT strength, fold, arg_min(penalty, struct_pack(e := e, p := penalty)) AS penalty FROM e GROUP BY 1, 2),
o AS (SELECT strength, fold, avg((d.y - my - w * (x - mx) / sx) ^ 2) AS e FROM d JOIN (SELECT * FROM w JOIN b USING (strength, fold, penalty)) USING (strength, fold) GROUP BY 1, 2),
r AS (SELECT strength, avg(e) AS mse FROM o GROUP BY 1)
SELECT strength, {r6('mse', 'mse')}, penalty, strength = (SELECT arg_min(strength, struct_pack(e := mse, s := strength)) FROM r) AS best FROM r JOIN b USING (strength) WHERE fold = -1""")
def gate_search_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strength of a gate on one column: each fold's ridge chooses its penalty by leave-one-out errors of its training rows."""
    rows = gated_design(spark, sf_dir).withColumn("x", F.slice("x", 1, 1))
    return _searched(spark, SEARCH.nested_search(rows, 1, [SEARCH.Gate((0,), s) for s in SEARCH.STRENGTHS], alike=True))


def _searched(spark: SparkSession, found: SEARCH.Found) -> DataFrame:
    table = [(s, e, p, k == found.best) for k, (s, e, p) in enumerate(zip(SEARCH.STRENGTHS, found.errors, found.penalties, strict=True))]
    return rounded(spark.createDataFrame(table, "strength double, mse double, penalty double, best boolean"), ["strength", "penalty", "best"])


@query()
def gate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with four columns, of which the first is gated."""
    return _searched(spark, SEARCH.nested_search(gated_design(spark, sf_dir), 4, [SEARCH.Gate((0,), s) for s in SEARCH.STRENGTHS], alike=True))


#: Derivative of the mean log likelihood by the parameter l, of the distinct values (name, v, n), by the closed forms.
_UP, _DOWN = "ln(1 + v)", "ln(1 - v)"
_VALUE = f"CASE WHEN v >= 0 THEN (exp(l * {_UP}) - 1) / l ELSE -(exp((2 - l) * {_DOWN}) - 1) / (2 - l) END"
_SLOPE = f"CASE WHEN v >= 0 THEN ({_UP} * exp(l * {_UP}) - (exp(l * {_UP}) - 1) / l) / l ELSE ({_DOWN} * exp((2 - l) * {_DOWN}) - (exp((2 - l) * {_DOWN}) - 1) / (2 - l)) / (2 - l) END"


@query("WITH RECURSIVE u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS v, count(*)::DOUBLE AS n FROM lineitem GROUP BY 2" for c in FEATURES) + f"""),
b AS (SELECT name, 0 AS k, -60.1::DOUBLE AS lo, 60.3::DOUBLE AS hi FROM (SELECT DISTINCT name FROM u)
  UNION ALL SELECT name, any_value(k) + 1, any_value(CASE WHEN d > 0 THEN l ELSE lo END), any_value(CASE WHEN d > 0 THEN hi ELSE l END) FROM (
    SELECT name, k, lo, hi, l, -(sum(n * (t - mt) * (s - ms)) / sum(n)) / (sum(n * (t - mt) ^ 2) / sum(n)) + sum(n * sign(v) * ln(1 + abs(v))) / sum(n) AS d FROM (
      SELECT *, sum(n * t) OVER o / sum(n) OVER o AS mt, sum(n * s) OVER o / sum(n) OVER o AS ms FROM (
        SELECT *, {_VALUE} AS t, {_SLOPE} AS s FROM (SELECT b.name, k, lo, hi, (lo + hi) / 2 AS l, v, n FROM b JOIN u USING (name) WHERE k < 50)) WINDOW o AS (PARTITION BY name)) GROUP BY name, k, lo, hi, l) GROUP BY name)
SELECT name, {r6('(lo + hi) / 2', 'lambda', 5)}, {r6('0', 'slope', 7)} FROM b WHERE k = 50""")
def yeo_johnson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column's parameter, and the derivative of its likelihood there, which is zero."""
    li = table(spark, sf_dir, "lineitem").select(*FEATURES).persist()
    found = T.fit_yeo_johnson(li, FEATURES)
    slopes = T.power_slopes(li, found)
    li.unpersist()
    return spark.createDataFrame([(c, round(lam, 5) + 0.0, round(slopes[c][0], 7) + 0.0) for c, lam in found.items()], "name string, lambda double, slope double")


@query("SELECT k::INTEGER AS fold, n // 5 + (k < n % 5)::INTEGER AS n, n // 5 + (k < n % 5)::INTEGER AS distinct_rows FROM (SELECT count(*) AS n FROM events), (SELECT unnest(range(0, 5)) AS k)")
def permuted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of five folds of a shuffle of the events' numbers, each of which is in one fold."""
    e = events(spark, sf_dir)
    bounds = e.agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).first()
    if bounds["low"] is None:
        return spark.createDataFrame([], "fold int, n long, distinct_rows long")
    rows = e.select((F.col("event_id") - bounds["low"]).alias("row_id"))
    return S.permuted(rows, bounds["high"] - bounds["low"] + 1).groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("distinct_rows"))


@query(f"""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), c AS (SELECT arg_min(user_id, struct_pack(n := n, u := user_id)) AS user_id FROM u),
k AS (SELECT event_id, value FROM events WHERE user_id = (SELECT user_id FROM c) AND value IS NOT NULL)
SELECT event_id, {r6('value', 'value')}, {r6('abs(value - (SELECT median(value) FROM k))', 'distance')} FROM k ORDER BY abs(value - (SELECT median(value) FROM k)), event_id LIMIT 1""")
def representative_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the subject with the fewest events, the one whose value is nearest their median."""
    e = events(spark, sf_dir)
    least = e.groupBy("user_id").count().orderBy("count", "user_id").limit(1).select("user_id")  # one row
    fine = e.where("value IS NOT NULL").join(F.broadcast(least), "user_id").select("event_id", F.col("value").cast("double").alias("value"))
    fine = durable(fine)
    return rounded(tasks.nearest_to_median(fine, "value", "event_id"), ["event_id"])


TWO_LAMBDAS = [0.0, 10.0, 1000.0, 100000.0]
#: Sums of l_quantity (u) and l_discount in hundredths (v), about the training rows' means, by held-out fold and penalty.
TWO_SQL = """d AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity::DOUBLE AS u, 100 * l_discount::DOUBLE AS v, l_extendedprice::DOUBLE / 1000 AS y FROM lineitem),
k AS (SELECT unnest(range(0, 5))::INTEGER AS held), m AS (SELECT held, count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, covar_pop(u, u) * count(*) AS uu, covar_pop(u, v) * count(*) AS uv,
  covar_pop(v, v) * count(*) AS vv, covar_pop(u, y) * count(*) AS uy, covar_pop(v, y) * count(*) AS vy FROM d JOIN k ON fold <> held GROUP BY 1)"""


@query(f"""WITH {TWO_SQL}, l AS (SELECT unnest({TWO_LAMBDAS})::DOUBLE AS penalty),
w AS (SELECT *, ((vv + penalty) * uy - uv * vy) / ((uu + penalty) * (vv + penalty) - uv * uv) AS a, ((uu + penalty) * vy - uv * uy) / ((uu + penalty) * (vv + penalty) - uv * uv) AS b FROM m, l),
e AS (SELECT penalty, held, sum((y - my - a * (u - mu) - b * (v - mv)) ^ 2) / (var_pop(y) * count(*)) AS e FROM d JOIN w ON fold = held GROUP BY 1, 2), s AS (SELECT penalty, avg(e) AS nmse FROM e GROUP BY 1)
SELECT penalty, {r6('nmse', 'nmse', 8)}, penalty = (SELECT min_by(penalty, nmse) FROM s) AS best FROM s""")
def ridge_cv_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = design(spark, sf_dir).withColumn("x", F.array(F.get("x", F.lit(0)), 100 * F.get("x", F.lit(1))))
    errors, best, _ = L.ridge_cv(rows, 2, TWO_LAMBDAS)
    return spark.createDataFrame([(lam, round(e, 8), k == best) for k, (lam, e) in enumerate(zip(TWO_LAMBDAS, errors, strict=True))], "penalty double, nmse double, best boolean")


CHOICE_ALPHAS, CHOICE_RATIOS = [0.01, 0.1, 1.0, 10.0], [0.1, 0.5, 1.0]


CHOICE_SQL = "d AS (SELECT (l_orderkey % 5)::INTEGER AS fold, l_quantity::DOUBLE AS x, l_quantity::DOUBLE * (1 - l_discount::DOUBLE) / 10 + l_orderkey % 7 AS y FROM lineitem)"


@query(f"""WITH {CHOICE_SQL}, p AS (SELECT alpha, ratio FROM (SELECT unnest({CHOICE_ALPHAS})::DOUBLE AS alpha), (SELECT unnest({CHOICE_RATIOS})::DOUBLE AS ratio)),
k AS (SELECT unnest(range(0, 5))::INTEGER AS held), m AS (SELECT held, avg(x) AS mx, avg(y) AS my, var_pop(x) AS q, covar_pop(x, y) AS c FROM d JOIN k ON fold <> held GROUP BY 1),
w AS (SELECT *, sign(c) * greatest(abs(c) - alpha * ratio, 0) / (q + alpha * (1 - ratio)) AS w FROM m, p),
e AS (SELECT alpha, ratio, held, avg((y - my - w * (x - mx)) ^ 2) AS e FROM d JOIN w ON fold = held GROUP BY 1, 2, 3), s AS (SELECT alpha, ratio, avg(e) AS mse FROM e GROUP BY 1, 2),
b AS (SELECT arg_min(struct_pack(a := alpha, r := ratio), mse) AS b FROM s), n AS (SELECT b.b.a AS alpha, b.b.r AS ratio, avg(x) AS mx, avg(y) AS my, var_pop(x) AS q, covar_pop(x, y) AS c FROM d, b GROUP BY 1, 2)
SELECT alpha, ratio, {r6('sign(c) * greatest(abs(c) - alpha * ratio, 0) / (q + alpha * (1 - ratio))', 'coef')}, {r6('my - mx * sign(c) * greatest(abs(c) - alpha * ratio, 0) / (q + alpha * (1 - ratio))', 'intercept')} FROM n""")
def elastic_net_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The penalty and mixture of least squared error over the folds, and the model of all rows with them."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("double")
    y = q * (1 - F.col("l_discount").cast("double")) / 10 + F.col("l_orderkey") % 7
    parts = G.normal_equations(li.select((F.col("l_orderkey") % 5).alias("fold"), F.array(q).alias("x"), y.alias("y")), 1, fold="fold")
    alpha, ratio, m = L.elastic_net_cv(parts, CHOICE_ALPHAS, CHOICE_RATIOS)
    return rounded(spark.createDataFrame([(alpha, ratio, float(m.coef[0]), m.intercept)], "alpha double, ratio double, coef double, intercept double"), ["alpha", "ratio"])


#: What a source of subjects lacks: of the columns of lineitem taken as a source each for seven suppliers' remainders.
LACKS = {"l_quantity": 3, "l_tax": 5}


@query("WITH d AS (SELECT l_orderkey, l_linenumber, l_suppkey % 7 AS source, " + ", ".join(f"CASE WHEN l_suppkey % 7 <> {LACKS.get(c, -1)} THEN {c}::DOUBLE END AS {c}" for c in FEATURES) + " FROM lineitem), u AS (" + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, source, '{c}' AS name, {c} AS value FROM d" for c in FEATURES) + """),
c AS (SELECT name FROM (SELECT name, source, count(value) AS n FROM u GROUP BY 1, 2) GROUP BY 1 HAVING min(n) > 0)
SELECT l_orderkey, l_linenumber, name, value FROM u WHERE name IN (SELECT name FROM c)""")
def subject_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of seven sources, two of which lack a column, with the columns that all have, in long form."""
    li = table(spark, sf_dir, "lineitem")
    source = F.col("l_suppkey") % 7
    rows = li.select(F.col("l_orderkey").alias("order"), F.col("l_linenumber").alias("line"), source.alias("source"), *[F.when(source != LACKS.get(c, -1), F.col(c).cast("double")).alias(c) for c in FEATURES])
    found = J.union_of_sources(rows, "source", ["order", "line"], FEATURES)
    return found.unpivot(["order", "line"], found.columns[2:], "name", "value").withColumnsRenamed({"order": "l_orderkey", "line": "l_linenumber"})


@query()
def gram_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A design of 64 columns: the vectors of embeddings against their label."""
    rows = table(spark, sf_dir, "embeddings").select(A.doubles(F.col("embedding")).alias("x"), F.col("label").cast("double").alias("y"))
    m = L.ridge(G.normal_equations(rows, 64)[0], 1.0)
    assert math.isfinite(m.intercept)
    return M.scores(rows.withColumn("p", m.predict()), "y", "p")
