"""Scans in order within a key, whose parallelism follows the rows: a key may hold most of them.

Rows are range-partitioned by key and order, so a long key lies in as many partitions as its rows fill. What happens inside
a partition is a window over (key, partition); what a partition needs from the others is carried by a table of one row a
key and partition. The dealt rows are written before they are read twice, as the cuts of a range partitioning are drawn from
a sample and must be the same for both.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Consecutive rows, or maps, that one fold takes in.
CHUNK = 4096


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all nodes share. Where none is named and all of Spark is in one
    process, a folder is made; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wavespark-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, written to the shared folder: a lost executor costs a reread."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dealt(rows: DataFrame, order: Sequence[str | Column], parts: int | None = None) -> DataFrame:
    """Rows with _part, a number that grows with the order given (key first). parts: how many at most, the session's number
    of shuffle partitions by default. Equal rows, too, may be cut apart."""
    salt = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*([parts] if parts else []), *order, salt)
    return durable(rows.withColumn("_part", F.spark_partition_id()))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, clip: bool = False, parts: int | None = None) -> DataFrame:
    """See joins.asof_forward."""
    columns = left.columns
    packed = left.select(*by, on, F.struct(*columns).alias("_row"))
    none = lambda field: F.lit(None).cast(field.dataType)
    right = right.where(F.col(value).isNotNull() & F.col(on).isNotNull())
    both = packed.withColumn("_value", none(right.schema[value])).unionByName(
        right.select(*by, on, none(packed.schema["_row"]).alias("_row"), F.col(value).alias("_value"))
    )
    # At the same position the rows of left come first, so they see right's when they look ahead.
    both = dealt(both.withColumn("_side", F.col("_row").isNull()), [*by, on, "_side"], parts)
    # Frames end at the current row, so that each is one step from the one before; looking ahead is looking back in
    # falling order.
    seen = lambda *ordering: F.last("_value", ignorenulls=True).over(W.partitionBy(*by, "_part").orderBy(*ordering).rowsBetween(W.unboundedPreceding, 0))
    near = [seen(F.desc(on), F.desc("_side")).alias("_next")]
    if clip:
        near.append(seen(F.asc(on), F.desc("_side")).alias("_before"))
    found = both.select(*by, on, "_part", "_row", *near).where("_row IS NOT NULL")
    mine = F.when(F.col("_side"), F.col(on))
    ends = both.groupBy(*by, "_part").agg(F.min_by("_value", mine).alias("_first"), F.max_by("_value", mine).alias("_last"))
    carry = lambda c, ordering: F.last(c, ignorenulls=True).over(W.partitionBy(*by).orderBy(ordering).rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(*by, "_part", carry("_first", F.desc("_part")).alias("_later"), carry("_last", F.asc("_part")).alias("_earlier"))
    found = found.join(ends, [*by, "_part"], "left")
    choice = ["_next", "_later", *(["_before", "_earlier"] if clip else [])]
    return found.select("_row.*", F.when(F.col(on).isNotNull(), F.coalesce(*choice)).alias("_found")).withColumnRenamed("_found", value)


def placed(rows: DataFrame, by: str, on: str, tie: str, parts: int | None = None) -> DataFrame:
    """See joins.place_in_order."""
    rows = dealt(rows, [by, on, tie], parts)
    sizes = rows.groupBy(by, "_part").agg(F.count("*").alias("_n"))
    per = W.partitionBy(by)
    before = F.coalesce(F.sum("_n").over(per.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), before.alias("_before"), F.sum("_n").over(per).alias("_count"))
    inner = F.row_number().over(W.partitionBy(by, "_part").orderBy(on, tie))
    same = rows[by].eqNullSafe(sizes["_by"]) & (rows["_part"] == sizes["_at"])
    return rows.withColumn("_inner", inner).join(sizes, same).withColumn("_place", F.col("_before") + F.col("_inner")).drop("_part", "_inner", "_before", "_by", "_at")


def lagged(rows: DataFrame, by: str, on: str, tie: str, parts: int | None = None) -> DataFrame:
    """See joins.previous."""
    rows = dealt(rows, [by, on, tie], parts)
    ends = rows.groupBy(by, "_part").agg(F.max(on).alias("_last"))
    earlier = F.max("_last").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), earlier.alias("_earlier"))
    same = rows[by].eqNullSafe(ends["_by"]) & (rows["_part"] == ends["_at"])
    inner = F.lag(on).over(W.partitionBy(by, "_part").orderBy(on, tie))
    return rows.withColumn("_inner", inner).join(ends, same).withColumn("_previous", F.coalesce("_inner", "_earlier")).drop("_part", "_inner", "_by", "_at", "_earlier")


# ------------------------------------------------------------------ exponential averages

#: A stretch of samples as a map of the state before it: level' = f level + l, var' = f var + q0 + q1 level + q2 level².
_MAP = ("f", "l", "q0", "q1", "q2")


def _map(f: Column, l: Column, q0: Column, q1: Column, q2: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in zip(_MAP, (f, l, q0, q1, q2), strict=True)])


def _then(a: Column, b: Column) -> Column:
    """First a, then b."""
    return _map(
        a["f"] * b["f"], b["f"] * a["l"] + b["l"], b["f"] * a["q0"] + b["q0"] + b["q1"] * a["l"] + b["q2"] * a["l"] * a["l"],
        b["f"] * a["q1"] + b["q1"] * a["f"] + 2 * b["q2"] * a["f"] * a["l"], b["f"] * a["q2"] + b["q2"] * a["f"] * a["f"],
    )


def _composed(maps: Column) -> Column:
    """Of an array of maps, in order; none is the map that changes nothing."""
    unchanged = _map(F.lit(1.0), *[F.lit(0.0)] * 4)
    return F.aggregate(maps, unchanged, _then)


def _sample(x: Column, keep: float) -> Column:
    """One sample: level' = keep level + (1 - keep) x, and the distance x - level' = keep (x - level) counts, squared."""
    gain = (1 - keep) * keep * keep
    return _map(F.lit(keep), (1 - keep) * x, gain * x * x, -2 * gain * x, F.lit(gain))


def _applied(m: Column, level: Column, var: Column) -> tuple[Column, Column]:
    return m["f"] * level + m["l"], m["f"] * var + m["q0"] + m["q1"] * level + m["q2"] * level * level


def _grouped(maps: DataFrame, by: str, chunk: int) -> DataFrame:
    """The maps of each run of chunk consecutive ones, as one map; at holds a map's number from 0."""
    runs = maps.groupBy(by, F.floor(F.col("at") / chunk).alias("at")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("run"))
    return runs.select(by, "at", _composed(F.transform("run", lambda r: r["m"])).alias("m"))


def _scan(rows: DataFrame, by: str, on: str, tie: str, value: str, half_life: float, parts: int | None, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """Samples as maps, numbered; the levels of runs over them up to one map a key; and each key's first sample and mean."""
    keep = float(0.5 ** (1 / half_life))
    samples = placed(rows, by, on, tie, parts)
    x = F.col(value).cast("double")
    ends = samples.groupBy(by).agg(F.min_by(x, "_place").alias("first"), F.avg(x).alias("mean"), F.max("_count").alias("n"))
    levels = [samples.select("*", (F.col("_place") - 1).alias("at"), _sample(x, keep).alias("m"))]
    most = ends.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(durable(_grouped(levels[-1], by, chunk)))
        most = -(-most // chunk)
    return levels, ends


def ewma(rows: DataFrame, by: str, on: str, tie: str, value: str, half_life: float, parts: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """by, n, level, std and momentum at each key's end: the exponentially weighted level (half_life in samples, seeded with
    the first one), the deviation (squared distances of samples from the level at their time, weighted in the same way)
    and the level less the plain mean.

    A parallel scan: a stretch of samples is an affine map of the level and a quadratic one of the variance, and maps
    compose. Runs of chunk consecutive samples are folded into one map each, runs of chunk maps into one, and so on, so a
    key's series of any length is never in one place. Values must not be null. Empty tables give an empty result."""
    levels, ends = _scan(rows, by, on, tie, value, half_life, parts, chunk)
    top = levels[-1].select(F.col(by).alias("_by"), "m")
    level, var = _applied(F.col("m"), F.col("first"), F.lit(0.0))
    return ends.join(top, ends[by].eqNullSafe(top["_by"])).select(by, "n", level.alias("level"), F.sqrt(var + 1e-12).alias("std"), (level - F.col("mean")).alias("momentum"))


def _states(run: pa.Table, after: bool) -> pa.Table:
    """A run's members with the state (level, var) before or after each, from the one that the run starts from."""
    order = run["at"].to_numpy().argsort()
    run = run.take(pa.array(order))
    maps = zip(*[run["m"].combine_chunks().field(k).to_pylist() for k in _MAP], strict=True)
    level, var, found = run["level"][0].as_py(), run["var"][0].as_py(), []
    for f, l, q0, q1, q2 in maps:
        old = level, var
        level, var = f * level + l, f * var + q0 + q1 * level + q2 * level * level
        found.append((level, var) if after else old)
    for k, c in enumerate(("level", "var")):
        run = run.set_column(run.schema.get_field_index(c), c, pa.array([x[k] for x in found], pa.float64()))
    return run


def ewma_filled(rows: DataFrame, by: str, on: str, tie: str, value: str, half_life: float, parts: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """rows with _place, _level and _var after each sample: the scan of ewma and its way back, on which every run passes to
    each of its members (chunk at most, one group) the state that it starts from."""
    levels, ends = _scan(rows, by, on, tie, value, half_life, parts, chunk)
    states = ends.select(by, F.lit(0).cast("long").alias("run"), F.col("first").alias("level"), F.lit(0.0).alias("var"))
    for k in range(len(levels) - 1, -1, -1):
        run = F.floor(F.col("at") / chunk) if k < len(levels) - 1 else F.lit(0).cast("long")
        members, states = levels[k].withColumn("run", run), states.select(F.col(by).alias("_by"), F.col("run").alias("_run"), "level", "var")
        members = members.join(states, members[by].eqNullSafe(states["_by"]) & (members["run"] == states["_run"])).drop("_by", "_run")
        fill = (lambda group: _states(group, False)) if k else (lambda group: _states(group, True))
        members = members.groupBy(by, "run").applyInArrow(fill, members.schema)
        states = durable(members.select(by, F.col("at").alias("run"), "level", "var")) if k else members
    return states.select(*rows.columns, "_place", F.col("level").alias("_level"), F.col("var").alias("_var"))
