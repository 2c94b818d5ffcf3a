"""What Python tasks keep between batches and tasks of one worker."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession

ROWS = 1000  # rows of a batch that are Python values at one time


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows; memory goes back after the last."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker stays for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def short_batches(spark: SparkSession, key: str = "spark.sql.execution.arrow.maxRecordsPerBatch") -> None:
    """Let batches of whole texts have at most ROWS rows, unless the session asks for fewer."""
    asked = int(spark.conf.get(key, "0"))
    if not 0 < asked <= ROWS:
        spark.conf.set(key, str(ROWS))


def once(key: str, make: Callable[[], Any]) -> Any:
    """The value made first under this key in this Python worker.

    Functions of this package are shipped by value, so their own module globals
    start anew with each task; this store does not.
    """
    store = sys.modules.setdefault("_postledger_worker", types.ModuleType("_postledger_worker"))
    if key not in store.__dict__:
        setattr(store, key, make())
    return store.__dict__[key]
