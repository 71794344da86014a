"""Vectors of an Arrow batch as a matrix, and a reduction tree over arrays: what the vector operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def usable(column) -> tuple[np.ndarray, np.ndarray]:
    """(places, matrix of doubles) of the vectors that are neither null nor empty and hold only finite components.

    Vectors of different lengths are an error.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(lengths)
    fine = (lengths > 0) & (bad[ends] == bad[ends - lengths])
    places = np.flatnonzero(fine)
    found = np.unique(lengths[places])
    if len(found) > 1:
        raise ValueError(f"vectors of {found[0]} and of {found[-1]} components in one column")
    width = int(found[0]) if len(found) else 0
    return places, flat[np.repeat(fine, lengths)].reshape(len(places), width)


def tree_sum(partials: DataFrame, read: Callable, merge: Callable, depth: int = 2):
    """The merge of what `read` makes of each row, through a reduction tree over the partitions; None without rows."""
    none = None

    def join(a, b):
        return b if a is None else a if b is None else merge(a, b)

    return partials.rdd.treeAggregate(none, lambda held, row: join(held, read(row)), join, depth)
