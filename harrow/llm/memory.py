"""Python workers live on after a task, so what a task no longer needs goes back to the system."""

from __future__ import annotations

import ctypes
import functools
import gc
import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: str):
    """``run`` that at its end empties the module-level dictionaries named in ``caches`` and returns free memory."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for name in caches:
                module, _, cache = name.rpartition(".")
                getattr(importlib.import_module(module), cache).clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
                trim.malloc_trim(0)

    return wrapped
