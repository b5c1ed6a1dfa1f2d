"""Vectors out of Arrow list columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrices(ids: pa.Array, lists: pa.Array):
    """(dimension, row numbers, float64 matrix) for the valid vectors of a batch.

    Left out are null ids, null vectors, empty vectors and vectors with a null,
    NaN or infinite component.
    """
    if len(lists) == 0:
        return
    offsets = np.asarray(lists.offsets)
    flat = lists.values
    bad = np.zeros(len(flat) + 1, np.int64)
    nulls = np.asarray(flat.is_null())
    value = np.asarray(flat.cast(pa.float64()).fill_null(0.0))
    np.cumsum(nulls | ~np.isfinite(value), out=bad[1:])
    start, end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
    size = end - start
    ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid()) & (size > 0) & (bad[end] == bad[start])
    for d in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == d))
        yield d, rows, value[start[rows][:, None] + np.arange(d)]


def units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are not zero, and these at length one; scaled first, so that
    squares of very large or small components neither overflow nor vanish."""
    top = np.abs(m).max(1, initial=0)
    ok = top > 0
    x = m[ok] / top[ok][:, None]
    return ok, x / np.sqrt((x * x).sum(1))[:, None]
