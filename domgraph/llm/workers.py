"""Memory of Python workers, which Spark keeps from one task to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give back to the system what this process has freed: the allocators of C and Arrow keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(function: Callable) -> Callable:
    """`function` of batches, with what its worker has freed given back before it, where other stages' tasks left it, and after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        try:
            yield from function(batches)
        finally:
            release()

    return run
