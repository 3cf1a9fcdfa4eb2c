"""The pending queue and the hash state of files.

Every function returns new or changed rows of a table; writing them is up to
the caller (see ``fpindex.sources.store``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import MODE_AUTO, MODE_FORCE, MODE_LAZY, MODE_MISSING, MODE_NEW
from fpindex.operators.joins import hot_join
from fpindex.operators.ranked import first_rows
from fpindex.sources.inventory import only_files
from fpindex.sources.metadata import import_packed


def seed_pending(files: DataFrame, state: DataFrame) -> DataFrame:
    """New state rows, marked ``new``, for files that have none; folders get none."""
    return (
        only_files(files)
        .select(F.col("fileid").alias("file_id"))
        .join(state.select("file_id"), "file_id", "left_anti")
        .select("file_id", F.lit(0).cast("long").alias("updated_at"), F.lit(MODE_NEW).alias("pending_mode"))
    )


#: Of several marks of a file without times the strongest counts.
STRENGTH = (MODE_FORCE, MODE_MISSING, MODE_LAZY, MODE_AUTO, MODE_NEW)


def mark_pending(state: DataFrame, marks: DataFrame) -> DataFrame:
    """State after marking ``marks(file_id, mode[, ts])``; files without a row stay unmarked.

    Of several marks of a file the last counts, or without ``ts`` the strongest.
    """
    rank = -F.array_position(F.array(*map(F.lit, STRENGTH)), F.col("mode"))
    rank = F.when(rank == 0, -len(STRENGTH) - 1).otherwise(rank)
    order = F.struct("ts", rank) if "ts" in marks.columns else rank
    last = marks.groupBy("file_id").agg(F.max_by("mode", order).alias("mode"))
    return state.join(last, "file_id", "left").select(
        "file_id", "updated_at", F.coalesce("mode", "pending_mode").alias("pending_mode")
    )


def clear_index(index: DataFrame, ids: DataFrame) -> DataFrame:
    """Index without the hashes of the given files."""
    return index.join(ids.select("file_id"), "file_id", "left_anti")


def clear_state(state: DataFrame, ids: DataFrame) -> DataFrame:
    """State with the given files invalidated: time 0 and no marker."""
    cleared = ids.select("file_id").distinct().withColumn("_cleared", F.lit(True))
    joined = state.join(cleared, "file_id", "left")
    hit = F.col("_cleared").isNotNull()
    return joined.select(
        "file_id",
        F.when(hit, F.lit(0).cast("long")).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(~hit, F.col("pending_mode")).alias("pending_mode"),
    )


def pending(state: DataFrame) -> DataFrame:
    return state.filter(F.col("pending_mode").isNotNull())


def pending_batch(state: DataFrame, limit: int) -> DataFrame:
    """Head of the queue by file id."""
    return first_rows(pending(state), [F.asc("file_id")], limit)


def pending_stats(state: DataFrame) -> DataFrame:
    """Files per pending mode."""
    return pending(state).groupBy("pending_mode").agg(F.count("*").alias("n"))


def sync_from_packed(files: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows the packed column knows and the index does not."""
    return import_packed(files).join(index.select("file_id", "algo"), ["file_id", "algo"], "left_anti")


def copy_checksums(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Files whose packed string changes because they were copied from another file.

    ``copies(source_file_id, file_id, ts, event_id)``: the last copy whose source
    has a checksum counts; a source without one changes nothing. Sources are
    read as they are in ``files``; for copies of copies see ``copies_in_order``.
    """
    sources = files.filter(F.coalesce("checksum", F.lit("")) != "").select(
        F.col("fileid").alias("source_file_id"), "checksum"
    )
    # one template may be the source of most copies
    inherited = hot_join(copies, sources, "source_file_id", spread_by="file_id")
    last = inherited.groupBy("file_id").agg(
        F.max_by("checksum", F.struct("ts", "event_id")).alias("checksum")
    )
    return last.join(files.select(F.col("fileid").alias("file_id")), "file_id", "left_semi")
