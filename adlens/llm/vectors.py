"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: str) -> Column:
    """True for a vector that is not null or empty and has only finite components."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(F.col(vec).isNotNull() & (F.size(vec) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of packed little-endian numbers as a matrix (all rows of one length)."""
    return np.stack([np.frombuffer(x.as_py(), dtype=dtype) for x in column])
