"""Tables whose size is measured before they are broadcast, and memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
from collections.abc import Callable, Hashable
from types import ModuleType
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.session import written

BROADCAST_BYTES = 64 << 20
#: Tables that a task left to the next one of its worker are dropped after so many seconds.
IDLE_SECONDS = 2.0

_Tables = TypeVar("_Tables")


def measured(df: DataFrame, width: str) -> DataFrame:
    """Write ``df``; hint it for broadcast if the sum of the SQL expression ``width``, its bytes a row, is small.

    A larger table is hinted for a shuffle: Spark would judge it by its compressed files.
    """
    table = written(df)
    size = table.agg(F.sum(F.expr(width).cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= BROADCAST_BYTES else table.hint("merge")


def give_back() -> None:
    """Return what a Python worker has freed to the system: it stays, idle, beside the workers of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def _shelf() -> ModuleType:
    """What the tasks of a worker share. Functions travel to it whole, so the names of this module are new in each task."""
    shelf = sys.modules.get("devicelog_shelf")
    if shelf is None:
        shelf = ModuleType("devicelog_shelf")
        shelf.lock, shelf.left, shelf.timer = threading.Lock(), {}, None
        sys.modules["devicelog_shelf"] = shelf
    return shelf


def take_up(key: Hashable, make: Callable[[], _Tables]) -> _Tables:
    """The tables that this worker's last task left under a key, or new ones; nobody else has them until they are left again."""
    shelf = _shelf()
    with shelf.lock:
        if shelf.timer:
            shelf.timer.cancel()
        shelf.timer, found = None, shelf.left.pop(key, None)
        shelf.left.clear()
    return make() if found is None else found


def leave(key: Hashable, tables: object) -> None:
    """Leave tables to the next task; a worker that gets none in time would hold them beside later stages."""
    shelf = _shelf()

    def drop() -> None:
        with shelf.lock:
            if shelf.timer is not timer:
                return  # a task came first
            shelf.left.clear()
            shelf.timer = None
        gc.collect()
        give_back()

    timer = threading.Timer(IDLE_SECONDS, drop)
    timer.daemon = True
    with shelf.lock:
        if shelf.timer:
            shelf.timer.cancel()
        shelf.left[key], shelf.timer = tables, timer
    timer.start()
