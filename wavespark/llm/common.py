"""Pieces that several operators share: tables, durable cuts of lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. Spark's lower() is used where the text is all ASCII, as both then agree."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Only where that is unset and all of
    Spark is in one process (tests, local runs) is one made; on a cluster it is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wavespark-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and cuts its lineage, so that a lost executor costs a reread only."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: for tables whose columns are read selectively."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as shuffles have: before each of few rows becomes many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def row_key(id_col: str, mark: Column) -> Column:
    """A key, never null, of a document by id and a hash of its text: an id alone need not be unique."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), mark.cast("string"))


def fresh(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever the case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem in taken:
        stem += "_"
    return stem


def exchanged(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """left and right joined by exchanges, whatever the session's broadcast threshold: for sides that grow with the input,
    each of which would otherwise be gathered by the driver and sent whole to every executor as long as it is below that."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph by randomised contraction.

    edges: (a long, b long), in any order, repeats and loops allowed, nulls ignored.
    Returns one row (node long, root long) for each node that has an edge to another node; all nodes of a component,
    and no others, have the same root, which is one of them. An empty edge table gives an empty result.

    Every round each node moves to the neighbour (or itself) of the lowest hash under that round's number (in the first
    round, the least one, which joins stars around their least node at once), and edges are rewritten to the places moved
    to, so that the graph shrinks by a constant factor whatever its shape. The only
    grouping is a minimum with map-side combining, so a hub of any degree costs one row a task; the joins have a unique
    side and both sides reach them by plain exchanges, which adaptive execution can split where a node is hot. The round
    is a column, not a literal, so that all rounds run the same generated code.

    Each round's edges are stored, not checkpointed: a checkpoint keeps the planner's estimate of its size, which for a
    join is the product of both sides', so that two joins a round would triple the estimate's digits every round, until
    it filled the driver. A stored table's size is that of its files.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = edges.withColumn("round", F.lit(0))
    moves: list[DataFrame] = []
    while True:
        edges = stored(edges)
        if edges.isEmpty():
            break
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near"), "round").unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("near"), "round")
        )
        rank_of = lambda c: F.when(F.col("round") == 0, F.col(c)).otherwise(F.xxhash64(c, "round"))
        rank = rank_of("near")
        nearest = both.groupBy("node").agg(F.min_by("near", rank).alias("near"), F.min(rank).alias("rank"), F.max("round").alias("round"))
        moved = F.when(F.col("rank") < rank_of("node"), F.col("near")).otherwise(F.col("node"))
        move = checkpoint(nearest.select("node", moved.alias("root")))
        moves.append(move)
        to_a = move.select(F.col("node").alias("a"), F.col("root").alias("x"))
        to_b = move.select(F.col("node").alias("b"), F.col("root").alias("y"))
        edges = (
            exchanged(exchanged(edges, to_a, "a"), to_b, "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("round") + 1).alias("round")).distinct()
        )
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves.pop()
    while moves:
        onward = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = exchanged(moves.pop(), onward, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return checkpoint(found)
