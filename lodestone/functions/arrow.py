"""Arrow helpers for ``mapInArrow`` operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa


def texts(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def fixed_binary(rows: np.ndarray) -> pa.Array:
    """A binary column with one value per row of a C-ordered two-dimensional array."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix(column: pa.Array, dtype: np.dtype, width: int) -> np.ndarray:
    """The inverse of :func:`fixed_binary`; the column must hold no nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.view(dtype).reshape(len(column), width)


def batch(names: Sequence[str], columns: Sequence[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=list(names))
