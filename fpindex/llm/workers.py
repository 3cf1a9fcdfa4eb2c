"""What a Python worker keeps between tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa


def kept(key: Hashable, make: Callable):
    """``make()`` once per worker and key.

    Functions travel to workers by value, and their module globals with them,
    so the store is a module of its own. It holds one tokenizer or model, whose
    size is bounded where it is made.
    """
    name = "_fpindex_kept"
    store = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("store", {})
    if key not in store:
        store.clear()
        store[key] = make()
    return store[key]


def trim() -> None:
    """Give memory that is free back to the system, where the C library can.

    Workers live on between tasks and stages, and memory they once used for
    arrays would count as theirs until then.
    """
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Sorted batches joined into tables, none of which splits the rows of a key.

    Holds the rows of one key and one batch at a time.
    """
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column)
        if waiting and waiting[-1].column(column)[-1] != keys[0]:
            yield pa.Table.from_batches(waiting)
            waiting = []
        other = np.flatnonzero(np.asarray(keys) != keys[-1].as_py())
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)
