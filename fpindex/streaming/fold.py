"""Folding file events into the queue.

The effect of a file's events on its marker does not need the events one after
another. Three maxima per file are enough: the last event that clears its
hashes, and the last event with an effect, once assuming that the file has
hashes and once that it has none. Maxima merge in any order, so the fold is an
ordinary aggregate: it combines before the shuffle however hot a file is,
replayed or late events do not change it, and batch and streaming runs agree.

| event | rule mode | effect |
|---|---|---|
| copied | any | marker ``auto`` |
| written | force, lazy | hashes cleared, marker is the mode |
| created | force | hashes cleared, marker ``force`` |
| created | lazy | marker ``lazy`` |
| written, created | auto | marker ``auto`` if the file has hashes |
| deleted | any but off | hashes and marker cleared |
| metadata | any | marker ``missing`` if the file has hashes, else ``new`` |
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fpindex.constants import MODE_AUTO, MODE_FORCE, MODE_LAZY, MODE_MISSING, MODE_NEW, MODE_OFF
from fpindex.operators.rules import Rule, match_rules
from fpindex.schemas import FILE_EVENTS

KINDS = ("created", "written", "copied", "deleted", "metadata")
PARTS = ("cleared", "if_hashed", "if_bare")


def event_source(spark: SparkSession, path: str, schema: T.StructType = FILE_EVENTS) -> DataFrame:
    """Stream of event files landing in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def parse_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Events of a message stream (such as Kafka) whose values are JSON objects.

    A value that cannot be read becomes an event without file and time of kind
    ``metadata``, which :func:`quarantine_events` picks up.
    """
    event = F.from_json(F.col(value).cast("string"), FILE_EVENTS.simpleString())
    parsed = messages.select(event.alias("e")).select("e.*")
    broken = F.col("kind").isNull() & F.col("file_id").isNull()
    return parsed.withColumn("kind", F.when(broken, "metadata").otherwise(F.col("kind")))


def usable(events: DataFrame) -> DataFrame:
    """Events of known kinds about a known file; other kinds are none of ours."""
    return events.filter(
        F.col("kind").isin(list(KINDS)) & F.col("file_id").isNotNull() & F.col("ts").isNotNull()
    )


def quarantine_events(events: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Events of known kinds that cannot be applied.

    With an inventory these are also the events of files that are not in it,
    except deletions.
    """
    known = F.col("kind").isin(list(KINDS))
    broken = F.col("file_id").isNull() | F.col("ts").isNull()
    if files is None:
        return events.filter(known & broken)
    there = files.select(F.col("fileid").alias("file_id")).distinct().withColumn("_there", F.lit(True))
    unplaced = F.col("_there").isNull() & (F.col("kind") != "deleted")
    return events.join(there, "file_id", "left").filter(known & (broken | unplaced)).drop("_there")


def locate_events(events: DataFrame, files: DataFrame) -> DataFrame:
    """Path and owner for events that come without them.

    Only the last event per file and kind matters to the fold, so events are
    reduced to those before they meet the inventory. Of files that are gone
    from it only the deletion stays, without place; it clears them. The rest
    is in :func:`quarantine_events`.
    """
    last = events.groupBy("file_id", "kind").agg(
        F.max(F.struct("ts", "event_id", "source_file_id")).alias("e")
    )
    places = files.select(
        F.col("fileid").alias("file_id"), "path", "owner", F.lit(True).alias("_there")
    )
    located = last.select("file_id", "kind", "e.*").join(places, "file_id", "left")
    return located.filter(F.col("_there") | (F.col("kind") == "deleted")).drop("_there")


def _effects(kind: Column, mode: Column, gone: Column) -> tuple[Column, Column, Column]:
    written, created = kind == "written", kind == "created"
    # no rule can keep the hashes of a file that has no place
    deleted = (kind == "deleted") & (gone | (mode.isNotNull() & (mode != MODE_OFF)))
    clears = (
        (written & mode.isin(MODE_FORCE, MODE_LAZY)) | (created & (mode == MODE_FORCE)) | deleted
    )
    common = (
        F.when(kind == "copied", MODE_AUTO)
        .when((written | created) & mode.isin(MODE_FORCE, MODE_LAZY), mode)
        .when(deleted, "")
    )
    if_hashed = common.when((written | created) & (mode == MODE_AUTO), MODE_AUTO).when(
        kind == "metadata", MODE_MISSING
    )
    if_bare = common.when(kind == "metadata", MODE_NEW)
    return F.coalesce(clears, F.lit(False)), if_hashed, if_bare


def fold_events(
    events: DataFrame,
    rules: Sequence[Rule],
    bucket: str | None = None,
    watermark: str | None = None,
) -> DataFrame:
    """Per file: ``cleared``, ``if_hashed`` and ``if_bare``, each ``struct<ts,event_id,effect>``.

    Works on batch and streaming events with ``path`` and ``owner``. With
    ``bucket`` (such as ``1 day``) the fold is kept per file and bucket of event
    time, and with ``watermark`` the state of old buckets is given up; without a
    watermark no event is ever too late.
    """
    ruled = match_rules(usable(events), rules)
    clears, if_hashed, if_bare = _effects(
        F.col("kind"), F.col("rule_mode"), F.col("path").isNull()
    )

    def at(condition: Column, effect: Column) -> Column:
        return F.max(F.when(condition, F.struct("ts", "event_id", effect.alias("effect"))))

    if watermark is not None:
        ruled = ruled.withWatermark("ts", watermark)
    keys = [F.col("file_id")]
    if bucket is not None:
        keys.append(F.window("ts", bucket))
    return (
        ruled.withColumn("_clears", clears)
        .withColumn("_hashed", if_hashed)
        .withColumn("_bare", if_bare)
        .groupBy(*keys)
        .agg(
            at(F.col("_clears"), F.lit("")).alias("cleared"),
            at(F.col("_hashed").isNotNull(), F.col("_hashed")).alias("if_hashed"),
            at(F.col("_bare").isNotNull(), F.col("_bare")).alias("if_bare"),
        )
        .select("file_id", *PARTS)
    )


def merge_folds(folds: DataFrame) -> DataFrame:
    """One row per file from any number of partial or repeated folds."""
    return folds.groupBy("file_id").agg(*[F.max(p).alias(p) for p in PARTS])


def apply_fold(
    state: DataFrame, index: DataFrame, folded: DataFrame, upsert: bool = False
) -> DataFrame:
    """State after the events: ``(file_id, updated_at, pending_mode, hash_count, cleared)``.

    Files without a state row stay without one unless ``upsert``.
    """
    counts = index.groupBy("file_id").agg(F.count("*").alias("n"))
    joined = (
        state.select("file_id", "updated_at", "pending_mode")
        .join(folded, "file_id", "full" if upsert else "left")
        .join(counts, "file_id", "left")
    )
    cleared = F.col("cleared").isNotNull()
    n = F.when(cleared, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    last = F.when(n > 0, F.col("if_hashed.effect")).otherwise(F.col("if_bare.effect"))
    return joined.select(
        "file_id",
        F.when(cleared, F.lit(0).cast("long"))
        .otherwise(F.coalesce("updated_at", F.lit(0).cast("long")) if upsert else F.col("updated_at"))
        .alias("updated_at"),
        F.when(last.isNull(), F.col("pending_mode"))
        .otherwise(F.nullif(last, F.lit("")))
        .alias("pending_mode"),
        n.alias("hash_count"),
        cleared.alias("cleared"),
    )


def start_fold(
    events: DataFrame,
    rules: Sequence[Rule],
    out: str,
    checkpoint: str,
    bucket: str | None = None,
    watermark: str | None = None,
    trigger: dict | None = None,
):
    """Run the fold as a stream that writes the changed rows of every batch.

    Each batch has a folder of its own that a retry overwrites, and rows may be
    read twice without harm, so restarts need no further care. Read the result
    with :func:`read_fold`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        fold_events(events, rules, bucket, watermark)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "60 seconds"}))
        .foreachBatch(write)
        .start()
    )


def read_fold(spark: SparkSession, out: str) -> DataFrame:
    """Current fold of a stream started with :func:`start_fold`."""
    return merge_folds(spark.read.parquet(out).select("file_id", *PARTS))
