"""Arrow batch kernels shared by the vector operators: list columns to matrices and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal widths as a float64 matrix; a NULL row, and a NULL component, is NaN in its place."""
    chunks = [c for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(c)]
    if not chunks:
        return np.zeros((0, 0))
    size = np.concatenate([np.asarray(pc.fill_null(pc.list_value_length(c), -1)) for c in chunks])
    there = size >= 0
    width = int(size.max(initial=0))
    if (size[there] != width).any():
        raise ValueError(f"vectors of different widths: {sorted(set(size[there].tolist()))[:5]}")
    out = np.full((len(size), width), np.nan)
    at = 0
    for c in chunks:
        mine = there[at : at + len(c)]
        values = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(int(mine.sum()), width)
        if mine.all():
            out[at : at + len(c)] = values
        else:
            out[at : at + len(c)][mine] = values
        at += len(c)
    return out


def lists(m: np.ndarray) -> pa.Array:
    """A matrix as a list<double> column."""
    m = np.ascontiguousarray(m, dtype=np.float64)
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.size else np.zeros(m.shape[0] + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


def column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy() if isinstance(table, pa.Table) else table.column(name).to_numpy(zero_copy_only=False)


def numbers(batch, name: str) -> np.ndarray:
    """A numeric column as float64 with NULL as NaN."""
    col = batch.column(name)
    return np.asarray(col.to_numpy() if isinstance(batch, pa.Table) else col.to_numpy(zero_copy_only=False), dtype=np.float64)
