"""Vectors of whole numbers from a table of embeddings, for the operators on vectors.

A component x becomes floor(SCALE * x), x as double. A vector takes part if it is there and all its components are there
and finite. Whole components beyond LIMIT (x of about 4096) are refused with an error: within it, products and squared
distances of up to MOST_DIMS components are exact in 53 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SCALE = 256
LIMIT = 1 << 20
MOST_DIMS = 1 << 10


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def whole(column: pa.ListArray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components one after the other)."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    x = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    take = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]])
    rows = np.flatnonzero(take)
    size = size[rows]
    ends = np.cumsum(size)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(at[:-1][rows] - (ends - size), size)
    v = np.floor(scale * x[index])
    if len(v) and np.abs(v).max() > LIMIT:
        raise ValueError(f"a component is beyond {LIMIT // scale}")
    if len(size) and size.max() > MOST_DIMS:
        raise ValueError(f"a vector has more than {MOST_DIMS} components")
    return rows, size, v.astype(np.int32)


def matrix(column: pa.ListArray, dims: int | None = None) -> np.ndarray:
    """The lists as rows of a matrix of 32-bit whole numbers; shorter ones end in zeros."""
    if not len(column):
        return np.zeros((0, dims or 0), np.int32)
    at = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(at)
    v = column.values.to_numpy()[at[0] : at[-1]]
    wide = int(size.max()) if len(size) else 0
    dims = wide if dims is None else dims
    if len(size) and (size == dims).all():
        return v.reshape(-1, dims)
    out = np.zeros((len(size), dims), np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(v)) - np.repeat(at[:-1] - at[0], size)] = v
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    """A matrix's rows as an Arrow column of lists."""
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.ascontiguousarray(rows).ravel()))
