"""What the operators on vectors share: which rows take part, and their components as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_complete(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its components are finite numbers."""
    x = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def dimension(rows: DataFrame, key: str, vector: str) -> int:
    """The length of the vector with the least key (0 without rows). Vectors of other lengths can't be compared with it."""
    n = rows.agg(F.min_by(F.size(vector), F.struct(F.col(key).isNull(), key, F.size(vector))).alias("n")).first()["n"]
    return n or 0


def as_integers(column: pa.Array, d: int, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) of a batch's vectors, a row each. Integers beyond ``limit`` could overflow later sums, so they are an error."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    whole = np.floor(flat * scale)
    if whole.size and np.abs(whole).max() > limit:
        raise ValueError(f"a component is beyond {limit / scale:g}: products of such vectors of {d} components are not exact in 64 bits")
    return whole.astype(np.int64)
