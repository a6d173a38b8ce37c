"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(name: str) -> Column:
    """True for vectors that are not null or zero and have finite components only."""
    fine = F.forall(name, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(name, lambda v: v != 0), F.lit(False))


def as_floats(df: DataFrame, name: str) -> Column:
    """The vector column as floats if it holds floats, else as doubles: no component loses a digit."""
    kind = df.schema[name].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)
    return F.col(name).cast("array<float>" if single else "array<double>")


def matrix(column, dim: int) -> np.ndarray:
    """A list column whose rows all have ``dim`` components, as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths of the rows, without overflow on the way; rows must not be zero."""
    top = np.abs(x).max(axis=1)
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1; rows must not be zero."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
