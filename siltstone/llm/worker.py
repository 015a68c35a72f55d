"""What a Python worker keeps between tasks, and how it gives memory back.

Workers live as long as their executor. They remember one model or memo at a time: a stage that
needs another drops the last one. After each task freed memory goes back to the system.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """The worker's one remembered object; made anew under another key."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow that releases memory when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]):
    """The same for applyInArrow."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return wrapped
