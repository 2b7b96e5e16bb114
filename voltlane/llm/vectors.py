"""Rows of vectors as the operators on embeddings take them, and as matrices inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole(vector: str = "embedding") -> Column:
    """Whether a vector and all its components are there and finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, odd), F.lit(False))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows ``row, id, label, vector`` that can take part: with an id, a label and a whole vector. ``row`` tells repeated rows apart."""
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole())
    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("vector"),
    )


def matrix(column: pa.ChunkedArray | pa.Array, dims: int = 0) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones with zeros behind; at least ``dims`` columns."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = np.diff(np.asarray(column.offsets)).astype(np.int64)
    values = np.asarray(column.flatten()).astype(np.float64)
    width = max(int(lengths.max(initial=0)), dims)
    if len(lengths) and (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def as_width(m: np.ndarray, dims: int) -> np.ndarray:
    return m if m.shape[1] == dims else np.pad(m, ((0, 0), (0, dims - m.shape[1])))
