"""Dealing rows to ranges of a whole-number id, without a sort of the table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, id_col: str, n: int) -> np.ndarray:
    """Up to n - 1 rising ids that cut the rows into about equal ranges; only the id is read."""
    if n < 2:
        return np.array([], np.int64)
    shares = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(id_col).cast("long"), shares, 20 * n).alias("b")).first()["b"]
    return np.unique(np.array(found or [], np.int64))


def range_of(ids: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Number of each id's range; a null is in the first."""
    least = np.iinfo(np.int64).min
    return np.searchsorted(bounds, pc.fill_null(ids.cast(pa.int64()), least).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
