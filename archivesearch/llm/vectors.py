"""Embeddings as scaled integers, for the operators on vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled components beyond this are taken as this, so that sums of products stay within a long.
LIMIT = 1 << 22


def usable(vector: Column) -> Column:
    """The vector is there, and each component is a finite number."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def scaled(vector: Column) -> Column:
    """Each component x as floor(256 * x)."""
    return F.transform(vector.cast("array<double>"),
                       lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(x * 256))).cast("int"))


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` components; shorter ones end in zeros."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out
