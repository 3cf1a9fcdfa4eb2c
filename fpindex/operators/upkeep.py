"""Keeping stored tables current: state, index, inventory and group counts follow every drain.

One commit of a :class:`VersionedStore` makes all of them current together and
rewrites the touched buckets alone. Group counts are kept by signed differences,
so that no drain groups the whole index again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.operators.attempts import ATTEMPTS
from fpindex.operators.drain import drained_files, drained_index, drained_state, outcome_index
from fpindex.operators.duplicates import KEYS, group_order
from fpindex.operators.lookup import checked_limit
from fpindex.operators.ranked import ranked
from fpindex.session import cut_lineage
from fpindex.sources.versions import BUCKETS, Change, Version, VersionedStore


def hash_counts(index: DataFrame) -> DataFrame:
    """``(algo, hash_value, file_count)`` of all hashes, those of a single file included."""
    return index.groupBy("algo", F.col("hash").alias("hash_value")).agg(F.count("*").alias("file_count"))


def count_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(algo, hash_value, change)``: what index rows that replace others do to the counts."""

    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select("algo", F.col("hash").alias("hash_value"), F.lit(sign).cast("long").alias("change"))

    both = signed(old, -1).unionByName(signed(new, 1))
    return both.groupBy(*KEYS).agg(F.sum("change").alias("change")).filter("change <> 0")


def merged_counts(counts: DataFrame, changes: DataFrame) -> DataFrame:
    """Counts after changes; hashes that no file has any more are gone."""
    n = F.coalesce("file_count", F.lit(0)) + F.coalesce("change", F.lit(0))
    return counts.join(changes, KEYS, "full").select(*KEYS, n.alias("file_count")).filter("file_count > 0")


def create_store(
    store: VersionedStore,
    files: DataFrame,
    state: DataFrame,
    index: DataFrame,
    buckets: int = BUCKETS,
    notes: Mapping | None = None,
) -> Version:
    """First version of a store with all tables."""
    index = index.select("file_id", "algo", "hash")
    tables = {
        "files": files,
        "state": state.select("file_id", "updated_at", "pending_mode"),
        "index": index,
        "groups": hash_counts(index),
        "attempts": files.sparkSession.createDataFrame([], ATTEMPTS),
    }
    return store.create(tables, buckets, notes)


def commit_outcome(
    store: VersionedStore,
    outcome: DataFrame,
    base: Version | None = None,
    notes: Mapping | None = None,
    packed: DataFrame | None = None,
    attempts: Callable[[DataFrame], DataFrame] | None = None,
) -> Version:
    """State, index, inventory and group counts after a drain, as one new version.

    ``outcome`` is that of a drain of the tables of ``base`` (the last version
    by default), one row per file. A commit that is killed leaves the store at
    ``base``, and can be repeated. ``packed(file_id, hashes, success)`` is given
    if the packed column does not follow the outcome itself, and ``attempts``
    if failures are counted, such as by ``next_attempts``.
    """
    base = base or store.version()
    outcome = cut_lineage(outcome)
    followed = outcome if packed is None else packed
    ids = outcome.select("file_id")
    buckets = store.touched_buckets("index", base, ids)
    old = store.read("index", base, buckets).join(ids, "file_id", "left_semi")
    changes = cut_lineage(count_changes(old, outcome_index(outcome)))
    waiting = {}
    if attempts is not None:
        waiting["attempts"] = Change(ids, attempts)
    return store.commit(
        waiting
        | {
            "state": Change(ids, lambda rows: drained_state(rows, outcome)),
            "index": Change(ids, lambda rows: drained_index(rows, outcome)),
            "files": Change(ids.withColumnRenamed("file_id", "fileid"), lambda rows: drained_files(rows, followed)),
            "groups": Change(changes, lambda rows: merged_counts(rows, changes)),
        },
        notes,
        base,
    )


def kept_page(
    store: VersionedStore,
    limit: int | None,
    offset: int = 0,
    algo: str | None = None,
    min_count: int = 2,
    version: Version | int | None = None,
) -> DataFrame:
    """A page of duplicate groups from the kept counts, in the order of ``page``.

    The index is read for the page's groups alone, to find the first and last
    file of each.
    """
    limit = checked_limit(limit)
    if not isinstance(version, Version):
        version = store.version(version)
    groups = store.read("groups", version).filter(F.col("file_count") >= max(2, min_count))
    if algo is not None:
        groups = groups.filter(F.col("algo") == algo.strip().lower())
    shown = ranked(groups, group_order()).slice(limit, max(0, offset))
    wanted = shown.select("algo", F.col("hash_value").alias("hash"))
    index = store.read("index", version)
    members = index.join(F.broadcast(wanted) if limit is not None else wanted, ["algo", "hash"], "left_semi")
    ends = members.groupBy("algo", F.col("hash").alias("hash_value")).agg(
        F.min("file_id").alias("first_file_id"), F.max("file_id").alias("last_file_id")
    )
    return shown.join(ends, KEYS).select(*KEYS, "file_count", "first_file_id", "last_file_id")
