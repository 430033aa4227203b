"""Windows made from the test tables, which hold no wearable signals.

A vector of embeddings is one second of a pulse signal at 64 Hz; ten with consecutive ids are a window of 640 samples.
Motion and skin channels of such a window are cut from the same samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A

BLOCKS, SECOND = 10, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), A.doubles(F.col("embedding")).alias("w"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("row_id", "w")))
    return (
        seconds(spark, sf_dir).groupBy(F.floor(F.col("row_id") / BLOCKS).alias("row_id")).agg(parts.alias("parts"))
        .where(F.size("parts") == BLOCKS).select("row_id", F.flatten(F.transform("parts", lambda p: p["w"])).alias("w"))
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bvp (640), acc_x, acc_y, acc_z (320) and eda (40) of each window."""
    w = F.col("w")
    return windows(spark, sf_dir).select(
        "row_id", w.alias("bvp"), F.slice(w, 1, 320).alias("acc_x"), F.slice(w, 321, 320).alias("acc_y"), A.every(w, 2).alias("acc_z"),
        F.transform(A.every(w, 16), lambda x: F.abs(x)).alias("eda"),
    )


#: The same for DuckDB: samples (row_id, pos, v) of seconds and windows.
SECONDS_SQL = "s AS (SELECT vec_id AS row_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
WINDOWS_SQL = (
    SECONDS_SQL + ", w AS (SELECT row_id // 10 AS row_id, (row_id % 10) * 64 + pos AS pos, v FROM s "
    "WHERE row_id // 10 IN (SELECT vec_id // 10 FROM embeddings GROUP BY 1 HAVING count(*) = 10))"
)


def rounded(df: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without negative zeros: sums come out in another order elsewhere."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *[(F.round(F.col(f"`{c}`"), digits) + 0.0).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns if c not in keys])


def r6(sql: str, name: str, digits: int = 6) -> str:
    return f"round(({sql})::DOUBLE, {digits}) + 0::DOUBLE AS {name}"
