"""Arrow columns of decoded records, cut out of whole batches of bytes at once with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..functions.network import MAPPED_PREFIX

UTC = pa.timestamp("us", tz="UTC")


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column (null: none) end to end, and the bounds of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def rows_of(data: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes from each start, one row each."""
    return data[start[:, None] + np.arange(width)] if len(start) else np.zeros((0, width), np.uint8)


def starts_of(first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of `count` records of `width` bytes from each first: where they start, whose they are, and their numbers there."""
    own = np.repeat(np.arange(len(count)), count)
    number = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return first[own] + number * width, own, number


def big_endian(rows: np.ndarray) -> np.ndarray:
    """The unsigned numbers that the rows' last 8 bytes spell, as 64 bits."""
    out = np.zeros(len(rows), np.uint64)
    for column in rows[:, -8:].T:
        out = out << np.uint64(8) | column
    return out


def addresses(rows: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    """16-byte addresses from rows of 4 or 16 bytes; null where not present."""
    n = len(rows)
    if rows.shape[1] == 4:
        wide = np.empty((n, 16), np.uint8)
        wide[:, :12] = np.frombuffer(MAPPED_PREFIX, np.uint8)
        wide[:, 12:] = rows
    else:
        wide = np.ascontiguousarray(rows)
    valid = None if present is None or present.all() else pa.py_buffer(np.packbits(present, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * 16).tobytes()), pa.py_buffer(wide.tobytes())])


def numbers(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.astype({pa.int16(): np.int16, pa.int32(): np.int32, pa.int64(): np.int64}[kind]), kind)


def instants(micros: np.ndarray, present: np.ndarray | None = None) -> pa.Array:
    return pa.array(micros.astype(np.int64), pa.int64(), mask=None if present is None else ~present).cast(UTC)
