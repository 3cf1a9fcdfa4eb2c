"""Timing an indexed lookup against a substring scan of the packed column."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.operators.lookup import filter_hash, scan_like


def _milliseconds(job: Callable[[], object], iterations: int) -> float:
    job()
    start = time.perf_counter()
    for _ in range(iterations):
        job()
    return (time.perf_counter() - start) * 1000


def compare_lookup(
    index: DataFrame, files: DataFrame, value: str, iterations: int = 100
) -> dict[str, float]:
    """Times of repeated lookups of one hash, by index and by scan, and table sizes."""
    indexed = filter_hash(index, value).limit(1)
    scanned = scan_like(files, value).limit(1)
    by_index = _milliseconds(lambda: indexed.collect(), iterations)
    by_scan = _milliseconds(lambda: scanned.collect(), iterations)
    return {
        "iterations": iterations,
        "index_ms_per_query": by_index / iterations,
        "scan_ms_per_query": by_scan / iterations,
        "speed_up": by_scan / max(by_index, 0.001),
        "filecache_rows": files.count(),
        "tracked_rows": index.select("file_id").distinct().agg(F.count("*")).first()[0],
    }
