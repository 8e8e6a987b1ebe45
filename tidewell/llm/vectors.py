"""What the operators on embeddings share: components as integers, and exact products of integer vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
#: Greatest size of an integer component of 64: four times a squared distance fits a long.
LARGEST = 1 << 26
#: Floats hold every integer below this exactly.
EXACT = 1 << 53


def finite(vector: Column) -> Column:
    """Whether the vector has no component that is null, NaN or infinite; false for a null vector."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(vector, bad), F.lit(False))


def quantised(vector: Column, largest: int = LARGEST) -> Column:
    """floor(256 * x) of each component as a long; a component too large for exact results stops the query."""

    def one(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * SCALE)
        return F.when(F.abs(x.cast("double")) * SCALE <= largest, scaled).otherwise(F.raise_error(F.lit(f"a component is beyond {largest} / {SCALE}")).cast("long"))

    return F.transform(vector, one)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64; shorter ones are filled with zeros up to width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T of integers, exactly: in floats where no sum can reach 2^53, else in longs."""
    if not x.size or not y.size:
        return np.zeros((len(x), len(y)), np.int64)
    if int(np.abs(x).max()) * int(np.abs(y).max()) * x.shape[1] < EXACT:
        return np.rint(x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    return x @ y.T
