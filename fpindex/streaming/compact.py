"""Streams over versioned tables: batches are logged, and folded into a new version now and then.

A batch of the drain works on the last version and on the outcomes logged since;
when ``every`` batches are logged they are committed as the next version, which
notes the last batch it has. So what a batch reads does not grow with the
history of the stream. Batches that a version before the last one has already
are deleted: readers of the last two versions find all they need.

Killed before its version is published, a commit is made again by the next
batch; killed after, the batch is found in the version and not repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.operators.attempts import due_state, wait_after, without_attempts
from fpindex.operators.drain import drained_files, drained_index, drained_state
from fpindex.operators.rehash import Content
from fpindex.operators.rules import Rule
from fpindex.operators.upkeep import commit_outcome
from fpindex.session import cut_lineage
from fpindex.sources.versions import Change, Version, VersionedStore, _Folder
from fpindex.streaming.drain import OUTCOME, process_batch
from fpindex.streaming.fold import PARTS, merge_folds, quarantine_events, usable

#: The note of a version that tells which batches it has.
BATCH = "batch"


def _batches(spark: SparkSession, out: str) -> list[int]:
    names = [n.partition("=") for n, _ in _Folder(spark, out).names("")]
    return sorted(int(b) for head, _, b in names if head == "batch_id" and b.isdigit())


def _drop_batches(spark: SparkSession, out: str, through: int) -> None:
    folder = _Folder(spark, out)
    for b in _batches(spark, out):
        if b <= through:
            folder.delete(f"batch_id={b}")


def logged(spark: SparkSession, out: str, version: Version, before: int | None = None) -> list[int]:
    """Batches that are logged and not in a version."""
    done = version.notes.get(BATCH, -1)
    return [b for b in _batches(spark, out) if b > done and (before is None or b < before)]


def tail_outcomes(spark: SparkSession, out: str, batches: Sequence[int]) -> DataFrame | None:
    """Last outcome of every file of some logged batches.

    Columns as of a drain's outcome, ``done_at`` and ``failures``, the number of
    failures since the last success. ``packed`` are the hashes of the last
    outcome that succeeded, null if none did: a failure leaves the packed
    column as the success before it made it.
    """
    if not batches:
        return None
    names = [*OUTCOME, "done_at"]
    parts = [spark.read.parquet(f"{out}/batch_id={b}").select(*names, F.lit(b).alias("batch_id")) for b in batches]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    done = F.when(F.col("success"), F.col("batch_id"))
    succeeded = rows.groupBy("file_id").agg(
        F.max_by(F.struct(*names[1:]), "batch_id").alias("o"),
        F.max_by("hashes", done).alias("packed"),
        F.max(done).alias("_done"),
        F.collect_list(F.when(~F.col("success"), F.col("batch_id"))).alias("_failed"),
    )
    since = F.filter("_failed", lambda b: b > F.coalesce("_done", F.lit(-1)))
    return succeeded.select("file_id", "o.*", "packed", F.size(since).alias("failures"), F.col("_done").isNotNull().alias("recovered"))


def waiting_after(attempts: DataFrame, tail: DataFrame) -> DataFrame:
    """Attempts after the logged batches; a success among them starts the count anew."""
    before = attempts.select("file_id", F.col("attempts").alias("_before"))
    untouched = attempts.join(tail.select("file_id"), "file_id", "left_anti")
    failed = tail.filter("failures > 0").join(before, "file_id", "left")
    earlier = F.when(F.col("recovered"), F.lit(0)).otherwise(F.coalesce("_before", F.lit(0)))
    counted = failed.select("file_id", (earlier + F.col("failures")).cast("int").alias("attempts"), "done_at")
    retried = counted.select("file_id", "attempts", (F.col("done_at") + wait_after(F.col("attempts"))).alias("retry_at"))
    return untouched.unionByName(retried)


def packed_outcome(outcome: DataFrame) -> DataFrame:
    """What the inventory's packed column follows, as the outcome of a drain."""
    return outcome.select("file_id", F.col("packed").alias("hashes"), F.col("packed").isNotNull().alias("success"))


def current(store: VersionedStore, out: str, before: int | None = None) -> dict[str, DataFrame]:
    """``state``, ``index``, ``files`` and ``attempts``: the last version and what was logged since."""
    version = store.version()
    tables = {name: store.read(name, version) for name in ("state", "index", "files", "attempts")}
    tail = tail_outcomes(store.spark, out, logged(store.spark, out, version, before))
    if tail is None:
        return tables
    return {
        "state": drained_state(tables["state"], tail),
        "index": drained_index(tables["index"], tail),
        "files": drained_files(tables["files"], packed_outcome(tail)),
        "attempts": waiting_after(tables["attempts"], tail),
    }


def compact(store: VersionedStore, out: str) -> Version:
    """Commit all logged batches as the next version."""
    version = store.version()
    batches = logged(store.spark, out, version)
    tail = tail_outcomes(store.spark, out, batches)
    if tail is None:
        return version
    tail = cut_lineage(tail)
    new = commit_outcome(
        store, tail, version, {BATCH: batches[-1]}, packed_outcome(tail), lambda rows: waiting_after(rows, tail)
    )
    _drop_batches(store.spark, out, version.notes.get(BATCH, -1))
    return new


def start_store_drain(
    events: DataFrame,
    store: VersionedStore,
    rules: Sequence[Rule],
    content: Content,
    out: str,
    checkpoint: str,
    now: Callable[[], int],
    every: int = 16,
    lazy: str = "clear",
    algos: Sequence[str] = ALGOS,
    trigger: dict | None = None,
):
    """Fold and drain as one stream over a store whose inventory has ``owner``.

    Read what it made with :func:`current`; the kept groups follow at each commit.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if store.version().notes.get(BATCH, -1) >= batch_id:
            return
        tables, moment = current(store, out, before=batch_id), now()
        # files that failed lately wait, unless the batch has an event of theirs
        waiting = without_attempts(tables["attempts"], usable(batch))
        state = due_state(tables["state"], waiting, moment)
        outcome = process_batch(
            batch, state, tables["index"], tables["files"], rules, content, moment, lazy, algos
        ).withColumn("done_at", F.lit(moment).cast("long"))
        outcome.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        quarantine_events(batch).write.mode("overwrite").parquet(f"{out}_quarantine/batch_id={batch_id}")
        if len(logged(spark, out, store.version())) >= every:
            compact(store, out)

    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .foreachBatch(step)
        .start()
    )


# -- the fold alone ------------------------------------------------------------


def fold_tail(spark: SparkSession, out: str, batches: Sequence[int]) -> DataFrame | None:
    if not batches:
        return None
    return merge_folds(spark.read.parquet(*[f"{out}/batch_id={b}" for b in batches]).select("file_id", *PARTS))


def compact_fold(store: VersionedStore, out: str) -> Version | None:
    """Merge the logged batches of ``start_fold`` into the fold of a store.

    Maxima merge in any order and any number of times, so nothing can be counted twice.
    """
    version = store.version()
    batches = _batches(store.spark, out) if version is None else logged(store.spark, out, version)
    tail = fold_tail(store.spark, out, batches)
    if tail is None:
        return version
    if version is None:
        return store.create({"fold": tail}, notes={BATCH: batches[-1]})
    new = store.commit(
        {"fold": Change(tail, lambda rows: merge_folds(rows.unionByName(tail)))}, {BATCH: batches[-1]}, version
    )
    _drop_batches(store.spark, out, version.notes.get(BATCH, -1))
    return new


def read_compacted_fold(store: VersionedStore, out: str) -> DataFrame | None:
    """Current fold: the last version and the batches since."""
    version = store.version()
    if version is None:
        return fold_tail(store.spark, out, _batches(store.spark, out))
    rows = store.read("fold", version).select("file_id", *PARTS)
    tail = fold_tail(store.spark, out, logged(store.spark, out, version))
    return rows if tail is None else merge_folds(rows.unionByName(tail))
