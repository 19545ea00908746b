"""Quantised vectors, shared by search and clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 64


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """array<int> of floor(scale * x), x as double; null for a null vector and for one with a null or non-finite component.

    A component of 2**31 / scale or more fails the query: its number wouldn't fit."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    fits = lambda c: F.when(F.abs(c) < (1 << 31) // scale, F.floor(c * scale)).otherwise(F.raise_error(F.lit("a component is too large to be quantised")).cast("long"))
    return F.when(finite, F.transform(x, lambda c: fits(c).cast("int")))


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    """A list column as rows of so many integers; shorter lists are filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == dimensions).all():
        return flat.reshape(len(sizes), dimensions)
    out = np.zeros((len(sizes), dimensions), dtype=np.int64)
    out[np.arange(dimensions)[None, :] < sizes[:, None]] = flat
    return out


def exact_kind(bound: int) -> type:
    """The type in which sums of integers up to bound are exact, the quickest first."""
    for kind, bits in ((np.float32, 24), (np.float64, 53), (np.int64, 63)):
        if bound < 1 << bits:
            return kind
    raise OverflowError("components are so large that a score or distance may not fit into a long")
