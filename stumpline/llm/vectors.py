"""Integer vectors from float embeddings, for the operators that compare them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: Column, dim: int | None = None) -> Column:
    """True for a non-null vector of only non-null, finite components (of ``dim`` of them if given); never null."""
    ok = vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    if dim is not None:
        ok = ok & (F.size(vector) == dim)
    return F.coalesce(ok, F.lit(False))


def scaled(vector: Column, factor: int, offset: int = 0) -> Column:
    """Every component c as the long floor(factor * c) + offset, c taken as a double (exact: factor is a power of two)."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")) + F.lit(offset))


def matrix(column: pa.Array, dim: int, dtype=np.int64) -> np.ndarray:
    """A list column whose rows all hold ``dim`` non-null values, as a (rows, dim) array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.astype(dtype, copy=False).reshape(len(column), dim)
