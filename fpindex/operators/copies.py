"""Copies one after another: a copy of a copy takes what its source had at that moment.

Every copy points to the last copy onto its source before it, or to what the
source had at the start. Following the pointers to their ends, which takes as
many rounds as the longest chain has doublings, tells which file's checksum a
copy brings. Copies of files without a checksum bring nothing; they are left
out first, and no pointer leads to them.

No task sees all events of a file: pointers come from one sort of all events by
file and time, in which only the borders between ranges are looked at apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.operators.joins import hot_join
from fpindex.operators.ranked import _AT, _RANGE_BITS, ranked
from fpindex.session import cut_lineage


def last_before(rows: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Add ``out``: the last ``value`` that is not null of the rows before, of the same ``key``.

    ``key`` and ``order`` leave no ties. Rows are sorted in ranges; a range
    whose first key began in an earlier one takes over what that one ended with.
    """
    listed = ranked(rows, [F.asc(key), F.asc(order)])
    stored = listed.rows.withColumn("_part", F.shiftright(_AT, _RANGE_BITS).cast("int"))
    ends = (
        stored.groupBy("_part")
        .agg(F.min(key).alias("first"), F.max(key).alias("last"))
        .orderBy("_part")
        .collect()
    )
    # of the last key of each range, its last value there
    last_keys = rows.sparkSession.createDataFrame(
        [(r["_part"], r["last"]) for r in ends], f"_part int, _last {rows.schema[key].dataType.simpleString()}"
    )
    left = (
        stored.join(F.broadcast(last_keys), "_part")
        .filter(F.col(key).eqNullSafe(F.col("_last")) & F.col(value).isNotNull())
        .groupBy("_part")
        .agg(F.max_by(value, _AT).alias("value"))
        .collect()
    )
    of_part, carried, brought = {r["_part"]: r["value"] for r in left}, (None, None), []
    for r in ends:
        begun = carried[1] if carried[0] == r["first"] else None
        brought.append((r["_part"], r["first"], begun))
        own = of_part.get(r["_part"])
        carried = (r["last"], own if own is not None else begun if r["first"] == r["last"] else None)
    kinds = f"_part int, _first {rows.schema[key].dataType.simpleString()}, _begun {rows.schema[value].dataType.simpleString()}"
    window = f"OVER (PARTITION BY _part, `{key}` ORDER BY {_AT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    here = F.expr(f"last(`{value}`, true) {window}")
    joined = stored.withColumn(out, here).join(F.broadcast(rows.sparkSession.createDataFrame(brought, kinds)), "_part")
    begun = F.when(F.col(key) == F.col("_first"), F.col("_begun"))
    return joined.select(*rows.columns, F.coalesce(out, begun).alias(out))


def _effective(copies: DataFrame, had: DataFrame) -> DataFrame:
    """Copies whose source has a checksum at that moment, from the start or by an earlier copy."""
    flagged = cut_lineage(copies.join(had.select("id", F.lit(True).alias("_had")), F.col("source") == F.col("id"), "left").drop("id"))
    found, waiting = flagged.filter("_had"), flagged.filter("_had IS NULL")
    new = found
    while True:
        # files get a checksum at the first copy that brings one
        since = new.groupBy(F.col("target").alias("id")).agg(F.min("at").alias("since"))
        more = hot_join(waiting.withColumn("id", F.col("source")), since, "id", spread_by="eid").filter("at > since")
        new = cut_lineage(more.select(*copies.columns, "_had"))
        if new.isEmpty():
            return found.select(*copies.columns)
        found = found.unionByName(new)
        waiting = cut_lineage(waiting.join(new.select("eid"), "eid", "left_anti"))


def copies_in_order(files: DataFrame, copies: DataFrame) -> DataFrame:
    """``(file_id, checksum)`` of the files that copies changed, after all of them in order.

    ``copies(source_file_id, file_id, ts, event_id)`` take effect one after
    another by time and event id. A copy of a file without a checksum changes
    nothing. Chains may lead through files that the inventory does not have;
    only files that it has are returned. Copies without a file, a source or a
    time are left out.
    """
    usable = copies.filter("source_file_id IS NOT NULL AND file_id IS NOT NULL AND ts IS NOT NULL")
    usable = usable.filter("source_file_id <> file_id").select(
        F.col("source_file_id").alias("source"),
        F.col("file_id").alias("target"),
        F.struct("ts", "event_id", "file_id", "source_file_id").alias("at"),
    )
    known = files.filter(F.coalesce("checksum", F.lit("")) != "").select(F.col("fileid").alias("id"), "checksum")
    events = cut_lineage(usable.dropDuplicates(["at"]).withColumn("eid", F.monotonically_increasing_id()))
    events = cut_lineage(_effective(events, known))
    # the same event as a copy onto its target and as one from its source
    onto = events.select(F.col("target").alias("file"), "at", F.col("eid").alias("came"), F.lit(None).cast("long").alias("went"))
    from_ = events.select(F.col("source").alias("file"), "at", F.lit(None).cast("long").alias("came"), F.col("eid").alias("went"))
    before = last_before(onto.unionByName(from_), "file", "at", "came", "pointer").filter("went IS NOT NULL")
    pointers = cut_lineage(before.select(F.col("went").alias("eid"), "pointer", F.col("file").alias("root")))
    while not pointers.filter("pointer IS NOT NULL").isEmpty():
        further = pointers.select(F.col("eid").alias("pointer"), F.col("pointer").alias("_next"), F.col("root").alias("_root"))
        # one copy onto a template may be what most copies point to
        moved = hot_join(pointers.filter("pointer IS NOT NULL"), further, "pointer", spread_by="eid")
        moved = moved.select("eid", F.col("_next").alias("pointer"), F.col("_root").alias("root"))
        pointers = cut_lineage(pointers.filter("pointer IS NULL").unionByName(moved))
    last = events.groupBy("target").agg(F.max_by("eid", "at").alias("eid"))
    roots = last.join(pointers.select("eid", F.col("root").alias("id")), "eid")
    brought = hot_join(roots, known, "id", spread_by="target").select(F.col("target").alias("file_id"), "checksum")
    return brought.join(files.select(F.col("fileid").alias("file_id")).distinct(), "file_id", "left_semi")
