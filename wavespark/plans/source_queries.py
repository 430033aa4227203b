"""Queries of the sources and sinks: what Spark derives from the tables is written as the tasks' files and read back."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import gram as G
from ..operators import joins as J
from ..operators import linear as L
from ..operators.ordered import shared_folder
from ..sources import subjects as sub
from ..sources import windows as src
from .fixtures import WINDOWS_SQL, channels, r6, rounded, table, windows

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def _new_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 10).alias("row_id")).agg(F.avg("label").alias("y"))


_PARTS = {"acc_x": "pos < 320", "acc_y": "pos >= 320", "acc_z": "pos % 2 = 0", "bvp": "true", "eda": "pos % 16 = 0"}


@query(f"""WITH {WINDOWS_SQL}, n AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS k FROM (SELECT DISTINCT row_id FROM w)), y AS (SELECT vec_id // 10 AS row_id, avg(label) AS y FROM embeddings GROUP BY 1)
SELECT k AS row_id, {r6('any_value(y)', 'y')}, {', '.join(r6(f"avg({'abs(v)' if c == 'eda' else 'v'}) FILTER (WHERE {p})", f'{c}_mean') + ', ' + r6(f"stddev_pop({'abs(v)' if c == 'eda' else 'v'}) FILTER (WHERE {p})", f'{c}_std') for c, p in _PARTS.items())}
FROM w JOIN n USING (row_id) JOIN y USING (row_id) GROUP BY k""")
def window_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as CSV of ten blocks and a target, read back: rows by number, channels, the target apart."""
    c = channels(spark, sf_dir).join(_labels(spark, sf_dir), "row_id")
    blocks = [F.slice(name, b * n + 1, n) for b in range(src.BLOCKS) for name, n in src.BLOCK_LAYOUT]
    cells = F.concat(F.concat(*blocks), F.array(F.col("y")))
    lines = c.select("row_id", F.array_join(F.transform(cells, lambda v: v.cast("string")), ",").alias("value"))
    header = spark.createDataFrame([(-1, ",".join([f"c{k}" for k in range(src.WIDTH)] + [src.TARGET]))], "row_id long, value string")
    path = _new_path(spark, "windows")
    header.unionByName(lines).orderBy("row_id").select("value").write.text(path)
    rows = src.require_target(src.read_table(spark, path))
    found = src.split_channels(F.col("x"))
    return rounded(rows.select("row_id", "y", *[f(w).alias(f"{name}_{k}") for name, w in found.items() for k, f in (("mean", A.mean), ("std", A.std))]), ["row_id"])


@query("SELECT row_number() OVER (ORDER BY user_id) - 1 AS row_id, round(avg(value), 6) + 0::DOUBLE AS value FROM events GROUP BY user_id")
def vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's mean, a number a line of six digits in the subjects' order, checked when it is read."""
    means = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("p"))
    path = _new_path(spark, "vector")
    src.write_vector(means, path, "p", 6, "user_id")
    return src.read_vector(spark, path, means.count()).withColumn("value", F.col("value") + 0.0)


@query("""WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT unnest(range(0, 5)) AS k)
SELECT k AS fold, (n * (k + 1)) // 5 AS fold_end, (10.0::DOUBLE ^ (k - 1)) AS penalty FROM n, k""")
def side_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of folds of the orders, in both notations that are read, and penalties, from their files."""
    n = table(spark, sf_dir, "orders").count()
    ends, folds, lambdas = [n * (k + 1) // 5 for k in range(5)], _new_path(spark, "folds"), _new_path(spark, "lambdas")
    spark.createDataFrame([(f"ends = {ends}",)], "value string").coalesce(1).write.text(folds)
    spark.createDataFrame([(k, f"{10.0 ** (k - 1)!r}\n") for k in range(5)], "k int, value string").orderBy("k").coalesce(1).select("value").write.text(lambdas)
    found, penalties = src.read_folds(spark, folds, n), src.read_lambdas(spark, lambdas)
    return spark.createDataFrame([(k, int(e), p) for k, (e, p) in enumerate(zip(found, penalties, strict=True))], "fold long, fold_end long, penalty double")


@query(f"SELECT l_suppkey, {r6('avg(l_quantity)', 'quantity')}, {r6('avg(l_discount)', 'discount')}, {r6('max(l_tax)', 'tax')} FROM lineitem GROUP BY 1")
def feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by supplier, written after a look at all values and read back with the same look."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.max("l_tax").alias("tax"))
    path, names = _new_path(spark, "features"), ["quantity", "discount", "tax"]
    src.write_features(rows, path, names)
    return rounded(src.checked_features(spark.read.parquet(path), names, rows.count()), ["l_suppkey"])


@query(f"""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT k::DOUBLE AS quantity, {r6('a * k + b', 'price', 3)} FROM m, (SELECT unnest(range(1, 51)) AS k)""")
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted line, written as a model and read back, at every quantity."""
    li = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double")).alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    model, path = L.ols(G.normal_equations(li, 1)[0]), _new_path(spark, "model")
    src.write_model(spark, path, {"intercept": model.intercept, "coef": model.coef.tolist()})
    state = src.read_model(spark, path)
    read = L.Linear(state["intercept"], np.array(state["coef"]))
    grid = spark.range(1, 51).select(F.col("id").cast("double").alias("quantity"), F.array(F.col("id").cast("double")).alias("x"))
    return rounded(L.predicted(grid, read, name="price").select("quantity", "price"), ["quantity"], 3)


def _archived(group: pd.DataFrame, folder: str) -> pd.DataFrame:
    """Writes some windows as one archive."""
    group = group.sort_values("row_id")
    content = io.BytesIO()
    np.savez_compressed(content, e4_hr=np.stack(group["w"].tolist())[:, :300].astype("f4"), glucose=group["y"].to_numpy(), timestamp=300.0 * group["row_id"].to_numpy())
    system, name, _ = sub.located(folder)
    with system.open_output_stream(f"{name}/{int(group['part'].iloc[0]):05}.npz") as f:
        f.write(content.getvalue())
    return pd.DataFrame({"n": [len(group)]})


@query(f"""WITH {WINDOWS_SQL}, y AS (SELECT vec_id // 10 AS row_id, avg(label) AS y FROM embeddings GROUP BY 1)
SELECT row_id, {r6('any_value(y)', 'glucose')}, {r6('avg(v)', 'mean', 5)}, {r6('stddev_pop(v)', 'std', 5)} FROM w JOIN y USING (row_id) WHERE pos < 300 GROUP BY 1""")
def archive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as archives of eight each, read by member and rows."""
    folder = _new_path(spark, "archives")
    system, name, _ = sub.located(folder)
    system.create_dir(name)
    rows = windows(spark, sf_dir).join(_labels(spark, sf_dir), "row_id").withColumn("part", F.floor(F.col("row_id") / 8))
    rows.groupBy("part").applyInPandas(lambda group: _archived(group, folder), "n long").agg(F.sum("n")).collect()
    found, hr = sub.read_archives(spark, folder, rows=3, rows_per_task=4), A.doubles(F.col("e4_hr"))
    found = found.select((F.col("ts") / 300).cast("long").alias("row_id"), "glucose", A.mean(hr).alias("mean"), A.std(hr).alias("std"))
    return rounded(found.withColumns({c: F.round(c, 5) for c in ("mean", "std")}), ["row_id"])


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE, 6) + 0::DOUBLE AS a, round(l_tax::DOUBLE, 6) + 0::DOUBLE AS c FROM lineitem WHERE l_suppkey % 4 = 1""")
def aligned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of two sources as one with the columns that both have; each written by itself and read back together."""
    li = table(spark, sf_dir, "lineitem").where("l_suppkey % 4 = 1")
    keys, path = ["l_orderkey", "l_linenumber"], _new_path(spark, "sources")
    wide = li.select(*keys, *[F.col(c).cast("double").alias(n) for n, c in (("a", "l_quantity"), ("b", "l_discount"), ("c", "l_tax"))])
    wide.where("l_orderkey % 2 = 0").write.parquet(f"{path}/source=0")
    wide.where("l_orderkey % 2 = 1").drop("b").write.parquet(f"{path}/source=1")
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    return rounded(J.union_of_sources(rows, "source", keys, ["a", "b", "c"]), keys)
