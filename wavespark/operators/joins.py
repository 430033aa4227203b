"""Joins by order and by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def asof_forward(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str, clip: bool = False, parts: int | None = None) -> DataFrame:
    """Adds to each row of left the first value of right at or after its position on, within the columns by; null if
    there is none, or with clip the last one before it. value is a column of right; its nulls don't count. A row of left
    without a position finds nothing.

    Both sides go through a sort of their union, instead of a join that would pair all rows of a key; a key's rows are dealt
    to as many partitions as they fill (see ordered), and what a partition lacks comes from the nearest one that has a value.
    """
    return ordered.nearest(left, right, by, on, value, clip, parts)


def place_in_order(rows: DataFrame, by: str, on: str, tie: str, parts: int | None = None) -> DataFrame:
    """Adds _place, the number (from 1) of a row among those of its key by on and then tie, and _count, the key's rows.
    A key's rows are numbered partition by partition, as asof_forward deals them, and the partitions' sizes added."""
    return ordered.placed(rows, by, on, tie, parts)


def previous(rows: DataFrame, by: str, on: str, tie: str, parts: int | None = None) -> DataFrame:
    """Adds _previous, the value of on in the row before, among those of its key by on and then tie; null in the first. A
    key's rows are dealt as asof_forward deals them; the first row of a partition looks to the ones before."""
    return ordered.lagged(rows, by, on, tie, parts)


def fold_of(rows: DataFrame, bounds: Sequence[tuple[int, int]], key: str = "row_id") -> DataFrame:
    """Adds fold, the number of the range [start, end) that key is in. Rows in none are left out. The ranges are a list
    on the driver, a few by nature, and so is the table that is broadcast."""
    table = rows.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(bounds)], "fold int, _start long, _end long")
    return rows.join(F.broadcast(table), (rows[key] >= F.col("_start")) & (rows[key] < F.col("_end"))).drop("_start", "_end")


def align(rows: DataFrame, names: Sequence[str], fill: float = float("nan")) -> DataFrame:
    """Exactly the columns names in this order; those that rows lacks are filled."""
    have = set(rows.columns)
    return rows.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in have else F.lit(fill).alias(c) for c in names])


#: Columns whose presence one number tells.
_BITS = 62


def common_columns(rows: DataFrame, source: str | Column, names: Sequence[str]) -> list[str]:
    """Those of names that have a value in every source, in the order given: one pass, in which each source's presence is a
    few bitmaps. Only null is absence; rows of no source at all have no common columns."""
    masks = []
    for k in range(0, len(names), _BITS):
        bits = [F.when(F.col(f"`{c}`").isNotNull(), F.lit(1 << j)).otherwise(F.lit(0)).cast("long") for j, c in enumerate(names[k : k + _BITS])]
        masks.append(F.bit_or(sum(bits[1:], bits[0])).alias(f"m{k // _BITS}"))
    if not masks:
        return []
    source = F.col(source) if isinstance(source, str) else source
    found = rows.groupBy(source.alias("_source")).agg(*masks).agg(*[F.bit_and(f"m{k}") for k in range(len(masks))]).first()
    return [c for k, c in enumerate(names) if (found[k // _BITS] or 0) >> (k % _BITS) & 1]


def union_of_sources(rows: DataFrame, source: str | Column, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """The rows of all sources, which one scan gives with null for what a source lacks: keys and the columns that all have."""
    return rows.select(*keys, *[F.col(f"`{c}`") for c in common_columns(rows, source, names)])


def union_common(tables: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL of the columns that all tables have, in the first one's order."""
    common = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    out = tables[0].select(*common)
    for t in tables[1:]:
        out = out.unionByName(t.select(*common))
    return out
