"""Vector columns as NumPy, shared by the two embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: Column) -> Column:
    """Neither null nor zero, no null or non-finite component (a float's largest square is finite in double)."""
    each = col.cast("array<double>")
    fine = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(col.isNotNull() & fine & F.exists(each, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equal-length lists as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so nothing overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def doubles(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float64()))


def with_width(df: DataFrame, col: str = "vector") -> DataFrame:
    return df.withColumn("width", F.size(col))
