"""Memory of Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system: a worker lives on between tasks, the executor's
    memory is shared, and a batch of long texts leaves large holes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_KEPT: list[dict] = []


def kept() -> dict:
    """A table that outlives its task in a worker, for one operator."""
    _KEPT.append({})
    return _KEPT[-1]


def keep_only(*own: dict) -> None:
    """To be called as a task begins: what other operators keep in this worker is dropped."""
    others = [table for table in _KEPT if table and not any(table is x for x in own)]
    for table in others:
        table.clear()
    if others:
        gc.collect()
        give_back()
