"""Keeps Python workers small: what a task has freed goes back to the system, as idle workers stay beside the JVM."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator


def release() -> None:
    """Return freed memory of Arrow's pool and of the C allocator, where it can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, with a release when its partition ends."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
