"""Events in, hashes out: every micro-batch is folded and its queue drained."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.operators.copies import copies_in_order
from fpindex.operators.drain import drain, drained_files, drained_index, drained_state
from fpindex.operators.asked import IdFilter, id_filter
from fpindex.operators.pending import clear_index
from fpindex.operators.rehash import Content
from fpindex.operators.rules import Rule
from fpindex.session import cut_lineage
from fpindex.streaming.fold import apply_fold, fold_events, quarantine_events, usable

OUTCOME = ["file_id", "updated_at", "next_pending", "hashes", "mode", "success", "error"]


@dataclass(frozen=True)
class Tables:
    """State and index as of the start of the stream; ``files`` has ``owner``.

    Given as a function, the inventory is read anew for every batch, so that
    files younger than the stream are found.
    """

    files: DataFrame | Callable[[], DataFrame]
    state: DataFrame
    index: DataFrame


def read_outcomes(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """Last outcome of every file touched so far, or none yet."""
    try:
        rows = spark.read.parquet(out)
    except AnalysisException:
        return None
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    # after a failure the packed column stays as the last success made it
    done = F.when(F.col("success"), F.col("batch_id"))
    return (
        rows.groupBy("file_id")
        .agg(F.max_by(F.struct(*OUTCOME[1:]), "batch_id").alias("o"), F.max_by("hashes", done).alias("packed"))
        .select("file_id", "o.*", "packed")
    )


def current_tables(spark: SparkSession, tables: Tables, out: str, before: int | None = None):
    """State and index with all outcomes up to a batch."""
    outcomes = read_outcomes(spark, out, before)
    if outcomes is None:
        return tables.state, tables.index
    return drained_state(tables.state, outcomes), drained_index(tables.index, outcomes)


def current_files(spark: SparkSession, tables: Tables, out: str, before: int | None = None) -> DataFrame:
    """Inventory whose packed column follows all outcomes up to a batch."""
    files = tables.files() if callable(tables.files) else tables.files
    outcomes = read_outcomes(spark, out, before)
    if outcomes is None:
        return files
    done = outcomes.select("file_id", F.col("packed").alias("hashes"), F.col("packed").isNotNull().alias("success"))
    return drained_files(files, done)


def with_copied_checksums(files: DataFrame, events: DataFrame, only: IdFilter | None = None) -> DataFrame:
    """Inventory in which copied files have the packed checksums their sources had at that moment.

    With ``only`` just the files of that filter are returned; sources may be any.
    """
    copies = cut_lineage(
        usable(events)
        .filter((F.col("kind") == "copied") & F.col("source_file_id").isNotNull())
        .select("source_file_id", "file_id", "ts", "event_id")
    )
    # a file may be copied over from any number of sources
    ends = copies.select(F.explode(F.array("file_id", "source_file_id")).alias("file_id"))
    pool = id_filter(ends).keep(files.select("fileid", "checksum"), "fileid")
    inherited = copies_in_order(pool, copies).select(
        F.col("file_id").alias("fileid"), F.col("checksum").alias("_inherited")
    )
    wanted = files if only is None else only.keep(files, "fileid")
    joined = wanted.join(inherited, "fileid", "left")
    return joined.withColumn("checksum", F.coalesce("_inherited", "checksum")).drop("_inherited")


def process_batch(
    events: DataFrame,
    state: DataFrame,
    index: DataFrame,
    files: DataFrame,
    rules: Sequence[Rule],
    content: Content,
    now: int,
    lazy: str = "clear",
    algos: Sequence[str] = ALGOS,
) -> DataFrame:
    """Outcome rows of one batch of events: drained files and files only cleared.

    Only the files of the batch and the backlog are worked on; the other rows of
    the state are dropped where they are read.
    """
    folded = cut_lineage(fold_events(events, rules))
    hit = id_filter(folded)
    # files of the batch, and the backlog
    at_rest, backlog = state.filter("pending_mode IS NULL"), state.filter("pending_mode IS NOT NULL")
    touched = hit.keep(at_rest).unionByName(backlog).select("file_id", "updated_at", "pending_mode")
    counted = hit.keep(index)
    marked = cut_lineage(apply_fold(touched, counted, folded, upsert=True))
    cleared = marked.filter("cleared")
    files = with_copied_checksums(files, events, id_filter(marked))
    drained = drain(
        marked, files, clear_index(index, cleared), rules, content, now, lazy, algos=algos
    ).select(*OUTCOME)
    only_cleared = cleared.filter(F.col("pending_mode").isNull()).select(
        "file_id",
        "updated_at",
        F.lit(None).cast("string").alias("next_pending"),
        F.create_map().cast("map<string,string>").alias("hashes"),
        F.lit(None).cast("string").alias("mode"),
        F.lit(True).alias("success"),
        F.lit(None).cast("string").alias("error"),
    )
    return drained.unionByName(only_cleared)


def start_drain(
    events: DataFrame,
    tables: Tables,
    rules: Sequence[Rule],
    content: Content,
    out: str,
    checkpoint: str,
    now: Callable[[], int],
    lazy: str = "clear",
    algos: Sequence[str] = ALGOS,
    trigger: dict | None = None,
):
    """Run fold and drain as one stream; the whole backlog is worked off per batch.

    A batch reads the outcomes of the batches before it and writes its own
    folder, so a retry after a lost executor or driver repeats exactly that
    batch. Events that cannot be applied go to ``<out>_quarantine``.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state, index = current_tables(spark, tables, out, before=batch_id)
        files = current_files(spark, tables, out, before=batch_id)
        outcome = process_batch(
            batch, state, index, files, rules, content, now(), lazy, algos
        )
        outcome.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        quarantine_events(batch).write.mode("overwrite").parquet(
            f"{out}_quarantine/batch_id={batch_id}"
        )

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .foreachBatch(step)
        .start()
    )
