"""Vectors as exact integers, for the operators on embeddings."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

#: Components beyond this are refused with an error: their squares and products would not fit into a long.
LIMIT = 1 << 31


def finite(vector: Column) -> Column:
    """Whether the vector and all its components are there and finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(math.inf)))


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component, with x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` integers; shorter lists end in zeros."""
    lengths = np.asarray(column.value_lengths()).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) and max(int(values.max()), -int(values.min())) > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT}")
    if (lengths == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def largest(m: np.ndarray) -> int:
    return max(int(m.max()), -int(m.min())) if m.size else 0
