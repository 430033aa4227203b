"""Links within groups of rows, when a group may hold a large share of all rows: enough of them to join what all would."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, exchanged

#: Weight of the rows that one task compares at a time; heavier groups are cut up.
BLOCK = 4096
#: Rows of a heavy group that each of its blocks is compared with first.
LEADERS = 16

#: kernel(groups, columns, trees) -> (x, y): links between rows of one group, which rows are sorted by. Rows of a group with
#: the same tree count as joined. With the links, just those rows are joined that all links of the relation would join.
Kernel = Callable[[np.ndarray, list[pa.Array], np.ndarray], tuple[np.ndarray, np.ndarray]]


def joining_links(trees: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (x, y) that join the rows of one group: near(x, rows) tells which of the rows are linked to x.

    A row is looked at once, against the rows not joined so far; at most one link goes out for each tree that is joined.
    """
    left, xs, ys = np.arange(len(trees)), [], []
    alone = len(np.unique(trees)) == len(trees)
    while len(left):
        own = trees[left] == trees[left[0]]
        queue, left = left[own].tolist(), left[~own]
        while queue and len(left):
            at = queue.pop()
            own = near(at, left)
            if not own.any():
                continue
            found = left[own]
            if not alone:
                found = found[np.unique(trees[found], return_index=True)[1]]
                own = np.isin(trees[left], trees[found])
            xs.append(np.full(len(found), at))
            ys.append(found)
            queue += left[own].tolist()
            left = left[~own]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys])


def bounds(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of sorted rows starts, and its rows."""
    start = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(groups)])


def stars(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between names x and y: the least name of each component, and each other name of it."""
    names, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = np.split(ends, 2)
    least = np.arange(len(names))
    while True:
        low = np.minimum(least[x], least[y])
        now = least.copy()
        np.minimum.at(now, x, low)
        np.minimum.at(now, y, low)
        now = now[now]
        if (now == least).all():
            break
        least = now
    other = np.flatnonzero(least < np.arange(len(names)))
    return names[least[other]], names[other]


def _links(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """Over rows (grp, name, tree, ...) sorted by group. The last group of a batch waits for the next batch, as it may go on there."""
    kept: list[pa.RecordBatch] = []

    def out(table: pa.Table) -> pa.RecordBatch:
        grp, name, tree = (table.column(k).to_numpy() for k in range(3))
        x, y = kernel(grp, [c.combine_chunks() for c in table.columns[3:]], tree)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in stars(name[x], name[y])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column(0).to_numpy()
        cut = int(np.searchsorted(grp, grp[-1]))
        if cut or kept and kept[-1].column(0)[0].as_py() != grp[0]:
            yield out(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield out(pa.Table.from_batches(kept))


def _dealt(rows: DataFrame, kernel: Kernel) -> DataFrame:
    rows = rows.repartition("grp").sortWithinPartitions("grp")
    return rows.mapInArrow(lambda batches: _links(batches, kernel), "a long, b long").where("a <> b")


def spanning(rows: DataFrame, kernel: Kernel, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of names, for rows (grp long, name long, weight, further columns): they join, in each group, just what
    all links of the kernel's relation would join. They lead from the least name of what a task joined to each other one,
    so that components of the pairs take few rounds; the two names of a pair need not be linked themselves.

    A group of weight up to block is one task's. The rows of a heavier one are dealt to blocks by hash, and each block is
    compared together with the same few leaders of the group, so that a group of rows that are mostly alike is joined in
    one pass that is linear in its size. Where a group is in several trees after that, blocks of different trees are
    compared pair by pair, never two of the same tree: whatever the sizes, no link between trees is missed.
    """
    rest = [c for c in rows.columns if c not in ("grp", "name", "weight")]
    hot = rows.groupBy("grp").agg(F.sum("weight").alias("size")).where(F.col("size") > block)
    hot = checkpoint(hot.select("grp", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    alone = ["grp", "name", F.col("name").alias("tree"), *rest]
    if hot.isEmpty():
        return _dealt(rows.select(*alone), kernel)
    cool = rows.join(hot, "grp", "left_anti").select(*alone)
    heavy = checkpoint(rows.join(hot, "grp"))
    own = F.pmod(F.xxhash64("name", F.lit(7)), "blocks").cast("int")
    least = [F.min_by("name", F.xxhash64("name", F.lit(k))) for k in range(LEADERS)]
    leaders = heavy.groupBy("grp").agg(F.array_distinct(F.array(*least)).alias("names")).select("grp", F.explode("names").alias("name"))
    leaders = heavy.join(leaders, ["grp", "name"], "left_semi").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A leader is in its own block twice; that is no link to another row.
    first = heavy.withColumn("own", own).unionByName(leaders)
    first = first.select(F.xxhash64("grp", "own").alias("grp"), "name", F.col("name").alias("tree"), *rest)
    found = checkpoint(_dealt(cool.unionAll(first), kernel).distinct())
    return found.unionAll(_dealt(_between_trees(heavy, found, rest, block), kernel))


def _between_trees(heavy: DataFrame, found: DataFrame, rest: list[str], block: int) -> DataFrame:
    """Rows of heavy groups that found leaves in several trees, once for each pair of blocks of different trees. A tree
    heavier than a block has blocks of its own; lighter ones share blocks, each tree in one."""
    trees = components(found).withColumnRenamed("node", "name")
    rows = exchanged(heavy, trees, "name", "left").withColumn("tree", F.coalesce("root", "name")).drop("root", "blocks")
    shares = rows.groupBy("grp", "tree").agg(F.sum("weight").alias("share"))
    several = shares.groupBy("grp").agg(F.count("*").alias("trees"), F.sum(F.when(F.col("share") <= block, F.col("share")).otherwise(0)).alias("light"))
    several = several.where("trees > 1").select("grp", F.ceil(F.col("light") / block).alias("pools"))
    shares = checkpoint(shares.join(several, "grp"))
    whole = F.col("share") > block
    blocks = F.when(whole, F.ceil(F.col("share") / block)).otherwise(F.lit(1))
    of = F.when(whole, F.col("tree")).otherwise(F.lit(None).cast("long"))
    pool = F.when(whole, F.lit(-1)).otherwise(F.pmod(F.xxhash64("tree", F.lit(11)), F.greatest("pools", F.lit(1))))
    places = shares.select("grp", "tree", of.alias("of"), blocks.alias("blocks"), pool.alias("pool"))
    place = lambda piece: F.xxhash64(F.coalesce("of", F.lit(0)), "pool", piece)
    listed = places.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", "of", place(F.col("piece")).alias("place")).distinct()
    x, y = listed.alias("x"), listed.alias("y")
    unlike = (F.col("x.place") < F.col("y.place")) & ~F.coalesce(F.col("x.of") == F.col("y.of"), F.lit(False))
    within = (F.col("x.place") == F.col("y.place")) & F.col("x.of").isNull()
    pairs = x.join(y, F.col("x.grp") == F.col("y.grp")).where(unlike | within).select(
        F.col("x.grp").alias("grp"), F.col("x.place").alias("one"), F.col("y.place").alias("two")
    )
    pairs = checkpoint(pairs)
    ends = pairs.select("grp", F.col("one").alias("place"), "one", "two").unionAll(pairs.where("one <> two").select("grp", F.col("two").alias("place"), "one", "two"))
    piece = F.pmod(F.xxhash64("name", F.lit(7)), "blocks")
    placed = rows.join(places, ["grp", "tree"]).withColumn("place", place(piece))
    return placed.join(ends, ["grp", "place"]).select(F.xxhash64("grp", "one", "two").alias("grp"), "name", "tree", *rest)
