"""Memory of Python workers, which Spark reuses from task to task."""

from __future__ import annotations

import ctypes
import functools
import gc

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: allocators keep it for the process otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lean(run):
    """A function of a task's batches, after which (or its failure) memory is given back."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
