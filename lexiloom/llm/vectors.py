"""Reading embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def rows_by_dimension(column: pa.Array):
    """(row numbers, matrix in double precision) for each dimension of a list column. Left out: null and empty vectors, and those with null or non-finite components or of norm zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.array([0 if x is None else x for x in pc.list_value_length(column).to_pylist()], np.int64)
    flat = column.flatten()
    holes = np.asarray(flat.is_null())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    for d in np.unique(lengths[lengths > 0]):
        row = np.flatnonzero(lengths == d)
        at = starts[row][:, None] + np.arange(d)
        x = values[at]
        good = np.isfinite(x).all(axis=1) & ~holes[at].any(axis=1) & (x != 0).any(axis=1)
        if good.any():
            yield row[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to norm one; by their largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
