"""Vector columns: which ones count, and numpy views of them inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Whether a vector is there, has entries, and all are finite numbers."""
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, odd), F.lit(False))


def commonest_length(rows: DataFrame, vec_col: str) -> int:
    """The length that most vectors have, of equal ones the greater; 0 for no rows. Only that one number reaches the driver."""
    lengths = rows.groupBy(F.size(vec_col).alias("d")).agg(F.count("*").alias("n"))
    return lengths.agg(F.max(F.struct("n", "d")).alias("m")).select(F.coalesce("m.d", F.lit(0)).alias("d")).first()["d"]


def matrix(column: pa.Array, kind: type) -> np.ndarray:
    """A list column of one length as a matrix."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
