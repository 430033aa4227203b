"""Window tables from CSV, side files of models, and text sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A window is ten one-second blocks, each holding these channels in this order (name, samples).
BLOCKS = 10
BLOCK_LAYOUT = (("acc_x", 32), ("acc_y", 32), ("acc_z", 32), ("bvp", 64), ("eda", 4))
BLOCK_WIDTH = sum(n for _, n in BLOCK_LAYOUT)
WIDTH = BLOCKS * BLOCK_WIDTH
TARGET = "hr"


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value, f, b, m) of text: in the order of f (file), b (start of the split) and m (number within the split) they are
    in file order. Spark itself reads the largest splits first."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))


def first_line(spark: SparkSession, path: str) -> str | None:
    """The first line of the first file that has one; none if there is no line."""
    return _placed_lines(spark, path).agg(F.min_by("value", F.struct("f", "b", "m")).alias("value")).first()["value"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (row_id, value) of text in file order: row_id counts from 0 over files in the order of their paths.

    Each split is counted; the counts, one row a split, are added up; and a line's number is its split's offset and its
    place within the split. Lines are never sorted or shuffled.
    """
    lines = _placed_lines(spark, path)
    splits = lines.groupBy("f", "b").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = F.coalesce(F.sum("n").over(W.orderBy("f", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = splits.select("f", "b", "first", before.alias("offset"))
    return lines.join(offsets, ["f", "b"]).select((F.col("offset") + F.col("m") - F.col("first")).alias("row_id"), "value")


def read_table(spark: SparkSession, path: str, target: str = TARGET, width: int | None = WIDTH) -> DataFrame:
    """row_id, x (all columns but the target, in the header's order) and y (null if there is no target) of a CSV file
    with a header. Numbers that can't be read, and rows of another width, raise an error."""
    first = first_line(spark, path)
    if first is None:
        raise ValueError(f"{path} has no header")
    header = [c.strip().strip('"') for c in first.split(",")]
    at = header.index(target) if target in header else None
    if width is not None and len(header) - (at is not None) != width:
        raise ValueError(f"{path} has {len(header) - (at is not None)} columns besides {target}, not {width}")
    lines = numbered_lines(spark, path).where("row_id > 0 AND trim(value) <> ''")
    cells = F.split("value", ",")
    checked = F.when(F.size(cells) == len(header), F.transform(cells, lambda c: F.trim(c).cast("double"))).otherwise(F.raise_error(F.lit("a row has another number of columns than the header")))
    rows = lines.select((F.col("row_id") - 1).alias("row_id"), checked.alias("v"))
    if at is None:
        return rows.select("row_id", F.col("v").alias("x"), F.lit(None).cast("double").alias("y"))
    return rows.select("row_id", F.concat(F.slice("v", 1, at), F.slice("v", at + 2, len(header) - at - 1)).alias("x"), F.get("v", F.lit(at)).alias("y"))


def require_target(rows: DataFrame) -> DataFrame:
    return rows.withColumn("y", F.coalesce("y", F.raise_error(F.lit(f"training rows need {TARGET}")).cast("double")))


def split_channels(x: Column) -> dict[str, Column]:
    """The channels of a window, each with its blocks put together."""
    out, offset = {}, 0
    for name, n in BLOCK_LAYOUT:
        out[name] = _channel(x, offset, n)
        offset += n
    return out


def _channel(x: Column, offset: int, n: int) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda b: F.slice(x, b * BLOCK_WIDTH + offset + 1, F.lit(n))))


def read_folds(spark: SparkSession, path: str, n: int) -> list[int]:
    """Exclusive ends of folds: every whole number in the file; the last must be n."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(r"(\d+)"), 1).alias("v")).first()["v"]
    ends = [int(v) for v in found]
    if not ends or ends[-1] != n or sorted(set(ends)) != ends:
        raise ValueError(f"fold ends must rise to {n}: {ends[:10]}")
    return ends


def read_bracketed_folds(spark: SparkSession, path: str, n: int, most: int = 5) -> list[int]:
    """The stricter form: the first [...] list of the file, of at most most ends."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    inside = text.partition("[")[2].partition("]")[0]
    ends = [int(v) for v in inside.replace(",", " ").split()]
    if not 1 <= len(ends) <= most or ends[-1] != n or sorted(set(ends)) != ends:
        raise ValueError(f"expected up to {most} rising fold ends in brackets, the last {n}")
    return ends


def read_lambdas(spark: SparkSession, path: str) -> list[float]:
    """One number on each line that isn't blank."""
    rows = numbered_lines(spark, path).where("trim(value) <> ''").select("row_id", F.trim("value").cast("double").alias("v")).orderBy("row_id")
    return [r["v"] for r in rows.collect()]


def read_vector(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(row_id, value) of a file of n lines, each one finite number; anything else raises an error."""
    lines = numbered_lines(spark, path).select("row_id", F.expr("try_cast(trim(value) AS double)").alias("value"))
    found = lines.agg(F.count("*").alias("n"), F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).alias("bad")).first()
    if found["n"] != n or found["bad"]:
        raise ValueError(f"{path}: {found['n']} lines, {found['bad']} of them no finite numbers; expected {n}")
    return lines


def check_table(rows: DataFrame) -> DataFrame:
    """One row: n, bad (rows with a value that isn't finite), targets (rows with one)."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count("y").alias("targets"))


def write_vector(rows: DataFrame, path: str, column: str, digits: int = 10, key: str = "row_id") -> None:
    """One number a line in the order of key, as a single part file; the format asks for one file."""
    rows.orderBy(key).coalesce(1).select(F.format_string(f"%.{digits}f", column)).write.mode("overwrite").text(path)


def write_errors(spark: SparkSession, path: str, lambdas: Sequence[float], errors: Sequence[float]) -> None:
    """lambda,error lines in the lambdas' order."""
    lines = [(k, f"{lam:g},{e:.6f}") for k, (lam, e) in enumerate(zip(lambdas, errors, strict=True))]
    spark.createDataFrame(lines, "k int, value string").orderBy("k").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_best(spark: SparkSession, path: str, best: float) -> None:
    """The chosen penalty, on one line."""
    spark.createDataFrame([(f"{best:.10g}",)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_report(rows: DataFrame, path: str) -> None:
    """One tab-separated file with a header, in the rows' order: for tables of a few rows, such as weights and scores."""
    rows.coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def _not_finite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def write_features(rows: DataFrame, path: str, names: Sequence[str]) -> None:
    """The columns names as doubles, with the other columns as they are, as Parquet; an error if a value isn't finite."""
    rows = rows.withColumns({c: F.col(f"`{c}`").cast("double") for c in names})
    checked_features(rows, names)
    rows.write.mode("overwrite").parquet(path)


def checked_features(rows: DataFrame, names: Sequence[str], n: int | None = None) -> DataFrame:
    """rows, after a look at all of them: an error unless they are n and have finite values in all columns names."""
    lacking = [c for c in names if c not in rows.columns]
    if lacking:
        raise ValueError(f"no columns {lacking[:5]}")
    found = rows.agg(F.count("*").alias("n"), *[F.count_if(_not_finite(F.col(f"`{c}`"))).alias(f"b{k}") for k, c in enumerate(names)]).first()
    bad = [c for k, c in enumerate(names) if found[f"b{k}"]]
    if bad or n is not None and found["n"] != n:
        raise ValueError(f"{found['n']} rows, expected {n}; not finite in {bad[:5]}")
    return rows


def write_model(spark: SparkSession, path: str, state: dict) -> None:
    """A model as JSON; reading one can run no code."""
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_model(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()["value"])
