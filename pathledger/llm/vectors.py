"""Embedding vectors as integers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

LONG = np.iinfo(np.int64)


def whole(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False))


def scaled(vector: str, factor: int) -> Column:
    """floor(factor * c) of each entry, taken as a double; beyond a long, the nearest long."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(factor)) * c.cast("double")))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow column of long lists, all of one length, as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def magnitude(*arrays) -> int:
    """The largest absolute value in the arrays, without wrapping around; 0 if they are empty."""
    return max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)


def exact(array: np.ndarray, bound: int) -> np.ndarray:
    """The array itself if results up to ``bound`` fit a long, else with unbounded Python integers."""
    return array if bound <= LONG.max else array.astype(object)


def longs(values) -> np.ndarray:
    """Integers as longs; beyond a long, the nearest one."""
    values = np.asarray(values)
    return values if values.dtype == np.int64 else np.clip(values, int(LONG.min), int(LONG.max)).astype(np.int64)
