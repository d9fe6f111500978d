"""Batches of rows in parts of bounded size: what a Python worker holds besides the batch itself doesn't grow with the batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts and contents that are taken together.
PART = 1 << 20


def parts(batch: pa.RecordBatch, *columns: int, most: int = PART) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows of which these columns (texts or bytes) take at most so many bytes, or one row that takes more."""
    size = np.zeros(len(batch) + 1, np.int64)
    for k in columns:
        size[1:] += np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0)).astype(np.int64) + 1
    done = np.cumsum(size)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(done, done[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, which gives its free memory back at the end, as workers live on between stages."""

    @wraps(f)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return apply
