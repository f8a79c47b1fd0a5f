"""Memory of Python workers.

A worker stays for later tasks, of other operators too, and keeps what the memory allocators have
once taken. ``trimmed`` hands that back when a task's work ends, so that the workers of a chain of
operators hold no more than the one at work needs.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.lru_cache(maxsize=1)
def _trim() -> Callable | None:
    """The C library's own call, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def release() -> None:
    """Hand free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def trimmed(work: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``work`` over batches, with free memory handed back when it ends."""

    @functools.wraps(work)
    def run(batches: Iterator, **options) -> Iterator:
        try:
            yield from work(batches, **options)
        finally:
            release()

    return run
