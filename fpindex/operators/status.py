"""Counts over all tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import PENDING_MODES


def status(files: DataFrame, index: DataFrame, state: DataFrame) -> DataFrame:
    """One row of counts.

    Pending files are counted in the known modes and one ``other`` bucket, so the
    row stays of fixed size.
    """
    marked = F.col("pending_mode").isNotNull()
    known = F.col("pending_mode").isin(list(PENDING_MODES))
    by_mode = F.struct(
        *[F.count_if(F.col("pending_mode") == m).alias(m) for m in PENDING_MODES],
        F.count_if(marked & ~known).alias("other"),
    )

    def count(df: DataFrame):
        return df.select(F.count("*")).scalar()

    return state.agg(
        F.count("*").alias("metadata_rows"),
        F.count_if(marked).alias("pending_total"),
        by_mode.alias("pending_by_mode"),
    ).select(
        count(files).alias("filecache_rows"),
        count(index).alias("hash_rows"),
        "metadata_rows",
        "pending_total",
        "pending_by_mode",
    )


def status_json(files: DataFrame, index: DataFrame, state: DataFrame) -> DataFrame:
    """The status as one JSON text."""
    counts = status(files, index, state)
    return counts.select(F.to_json(F.struct(*counts.columns)).alias("json"))
