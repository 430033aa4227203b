"""Kernels over Arrow batches: array columns in, one column a feature out."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Kernel = Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; null arrays, null elements and arrays of another length are NaN."""
    out = np.full((len(column), width), np.nan)
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit = sizes == width
    if fit.any():
        out[fit] = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def _applied(batches: Iterator[pa.RecordBatch], kernel: Kernel, widths: Mapping[str, int], names: list[str], kept: int, rows: int, packed: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            found = kernel({c: matrix(batch.column(kept + k), w) for k, (c, w) in enumerate(widths.items())}, batch.num_rows)
            values = [np.asarray(found[n], float) for n in names]
            if packed:
                out = [pa.FixedSizeListArray.from_arrays(pa.array(np.stack(values, 1).ravel()), len(names)).cast(pa.list_(pa.float64()))]
            else:
                out = [pa.array(v) for v in values]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *out], [*batch.schema.names[:kept], *(["x"] if packed else names)])


def names_of(kernel: Kernel, widths: Mapping[str, int]) -> list[str]:
    """A kernel's columns, from a window of noise."""
    noise = np.random.default_rng(0)
    return list(kernel({c: noise.normal(size=(2, w)) + 1 for c, w in widths.items()}, 2))


def apply_kernel(df: DataFrame, kernel: Kernel, widths: Mapping[str, int], keep: list[str], rows: int = 256, packed: bool = False) -> DataFrame:
    """The columns keep, and the kernel's: each as a double, or all as one array x if packed (see names_of for their order).

    widths: the array columns that the kernel takes and their lengths. A kernel sees at most rows windows at a time, so
    its memory is bounded; the plan is narrow and shuffles nothing.
    """
    names = names_of(kernel, widths)
    slim = df.select(*keep, *[df[c].cast("array<double>").alias(c) for c in widths])
    kinds = ", ".join(f"`{c}` {t}" for c, t in slim.dtypes[: len(keep)])
    own = "x array<double>" if packed else ", ".join(f"`{n}` double" for n in names)
    return slim.mapInArrow(lambda batches: _applied(batches, kernel, dict(widths), names, len(keep), rows, packed), f"{kinds}, {own}" if keep else own)
