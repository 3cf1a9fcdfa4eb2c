"""Groups of files with the same content.

A group is a row ``(algo, hash_value, file_count, first_file_id, last_file_id)``
and its members are rows of their own. Counting is pre-aggregated before the
shuffle; members meet their group through a join that splits large groups, so
no task and no row ever holds a whole group. Nested lists come in parts of a
bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import HOT_GROUP_ROWS, INDEX_VALUE_LENGTH
from fpindex.functions.paths import display_path
from fpindex.functions.codec import index_value
from fpindex.operators.joins import join_groups, spread_join
from fpindex.operators.lookup import checked_limit
from fpindex.operators.paths import resolve_paths
from fpindex.operators.ranked import ranked

KEYS = ["algo", "hash_value"]
PART_FILES = 10_000


def _members(index: DataFrame, algo: str | None) -> DataFrame:
    rows = index if algo is None else index.filter(F.col("algo") == algo.strip().lower())
    return rows.select("algo", F.col("hash").alias("hash_value"), "file_id")


def duplicate_groups(index: DataFrame, algo: str | None = None, min_count: int = 2) -> DataFrame:
    """Groups with at least ``min_count`` (never under 2) files."""
    return (
        _members(index, algo)
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("file_count"),
            F.min("file_id").alias("first_file_id"),
            F.max("file_id").alias("last_file_id"),
        )
        .filter(F.col("file_count") >= max(2, min_count))
    )


def group_order() -> list[Column]:
    """Largest group first; ties by algorithm and hash."""
    return [F.desc("file_count"), F.asc("algo"), F.asc("hash_value")]


def page(
    groups: DataFrame,
    limit: int | None,
    offset: int = 0,
    after: tuple[int, str, str] | None = None,
) -> DataFrame:
    """One page of groups in order, with ``has_more`` and the true ``total_groups``.

    ``offset`` skips groups one by one; to go deep, give ``after``: the
    ``(file_count, algo, hash_value)`` of the last group of the page before.
    ``limit=None`` gives all groups behind the offset. The groups are computed
    once, for the page and both numbers.
    """
    limit, offset = checked_limit(limit), max(0, offset)
    listed = ranked(groups, group_order())
    if after is None:
        shown, left = listed.slice(limit, offset), listed.total
    else:
        count, algo, value = after
        n, name, key = F.col("file_count"), F.col("algo"), F.col("hash_value")
        behind = (n < count) | ((n == count) & ((name > algo) | ((name == algo) & (key > value))))
        left = listed.rows.filter(behind).count()
        shown = listed.slice(limit, listed.total - left + offset)
    return shown.withColumn("total_groups", F.lit(listed.total).cast("long")).withColumn(
        "has_more", F.lit(limit is not None and left > offset + limit)
    )


def duplicate_members(
    index: DataFrame,
    algo: str | None = None,
    min_count: int = 2,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """One row per member of every group: ``(algo, hash_value, file_count, file_id)``."""
    groups = duplicate_groups(index, algo, min_count).select(*KEYS, "file_count")
    return join_groups(_members(index, algo), groups, KEYS, "file_count", "file_id", hot_rows)


def members_of(groups: DataFrame, index: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Member rows of given groups, such as one page of them."""
    return join_groups(_members(index, None), groups, KEYS, "file_count", "file_id", hot_rows)


def duplicates_with_paths(
    index: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    user: str | None = None,
    algo: str | None = None,
    min_count: int = 2,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Resolved member rows of groups that still have ``min_count`` visible files.

    ``file_count`` counts the visible files, ``total_count`` all files with the
    hash. Files without a path are dropped and count only in the total.
    """
    least = max(2, min_count)
    paths = resolve_paths(files, storages, user).drop("storage_id")
    members = duplicate_members(index, algo, least, hot_rows).withColumnRenamed(
        "file_count", "total_count"
    )
    resolved = members.join(paths.withColumnRenamed("fileid", "file_id"), "file_id")
    visible = (
        resolved.groupBy(*KEYS)
        .agg(F.count("*").alias("file_count"))
        .filter(F.col("file_count") >= least)
    )
    return join_groups(resolved, visible, KEYS, "file_count", "file_id", hot_rows).select(
        *KEYS,
        "file_count",
        "total_count",
        F.col("file_id").alias("fileid"),
        display_path(F.col("path"), F.col("name")).alias("path"),
        "name",
        "owner",
    )


def visible_groups(
    index: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    user: str | None = None,
    algo: str | None = None,
    min_count: int = 2,
) -> DataFrame:
    """Groups a user sees, counting only the files the user sees."""
    seen = resolve_paths(files, storages, user).select(F.col("fileid").alias("file_id"))
    return duplicate_groups(index.join(seen, "file_id", "left_semi"), algo, min_count)


def nest_members(
    members: DataFrame,
    part_files: int = PART_FILES,
    file_columns: tuple[str, ...] = (),
    group_columns: tuple[str, ...] = (),
) -> DataFrame:
    """Members as ``files`` arrays, a group of ``n`` files in about ``n/part_files`` parts.

    The rows keep every member; only groups above ``part_files`` files have more
    than one part, and no array grows with its group.
    """
    id_col = "fileid" if "fileid" in members.columns else "file_id"
    columns = list(file_columns) or [id_col]
    parts = F.ceil(F.col("file_count") / part_files)
    part = F.when(F.col("file_count") <= part_files, F.lit(0)).otherwise(
        F.pmod(F.xxhash64(id_col), parts)
    )
    return (
        members.withColumn("part", part.cast("long"))
        .groupBy(*KEYS, "file_count", *group_columns, "part")
        .agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("files"))
    )


def same_hash_counts(index: DataFrame) -> DataFrame:
    """For every file and algorithm, how many other files have the same hash."""
    return duplicate_members(index).select(
        "file_id", *KEYS, (F.col("file_count") - 1).alias("other_files")
    )


def same_hash(
    index: DataFrame,
    ids: DataFrame,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Files that share a hash with any file in ``ids(file_id)``.

    The result has one row per (algo, hash, file), never one per pair: a file
    asked for is listed only if another one asked for has the same hash. Groups
    are counted before their members are joined, so that hot ones are split.
    """
    probes = ids.select("file_id").distinct()
    members = _members(index, None)
    flagged = members.join(probes.withColumn("_asked", F.lit(True)), "file_id", "left")
    groups = (
        flagged.groupBy(*KEYS)
        .agg(
            F.count("*").alias("_n"),
            F.count("_asked").alias("probe_count"),
            F.min(F.when(F.col("_asked"), F.col("file_id"))).alias("_probe"),
        )
        .filter("_n > 1 AND probe_count > 0")
    )
    rows = join_groups(members, groups, KEYS, "_n", "file_id", hot_rows)
    return rows.filter((F.col("probe_count") > 1) | (F.col("file_id") != F.col("_probe"))).select(
        *KEYS, "file_id", "probe_count"
    )


def same_hash_with_paths(
    index: DataFrame,
    ids: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    user: str | None = None,
) -> DataFrame:
    """As :func:`same_hash`, with paths and only the files a user sees."""
    paths = resolve_paths(files, storages, user).select(
        F.col("fileid").alias("file_id"), "path", "name"
    )
    return same_hash(index, ids).join(paths, "file_id").select(
        *KEYS, F.col("file_id").alias("fileid"), "path", "name"
    )


def same_hash_of(index: DataFrame, file_id: int) -> DataFrame:
    """Other files with any of one file's hashes: ``(algo, hash_value, file_id)``."""
    mine = (
        _members(index, None).filter(F.col("file_id") == file_id).select(*KEYS).distinct()
    )
    return spread_join(
        _members(index, None), mine, KEYS, spread_by="file_id", how="left_semi"
    ).filter(F.col("file_id") != file_id)


def prefix_collisions(index: DataFrame, length: int = INDEX_VALUE_LENGTH) -> DataFrame:
    """Hashes that are different but agree on their first ``length`` characters."""
    value = F.col("hash")
    cut = index_value(value) if length == INDEX_VALUE_LENGTH else F.substring(value, 1, length)
    hashes = index.groupBy("algo", "hash").agg(F.count("*").alias("n"))
    return (
        hashes.groupBy("algo", cut.alias("hash_prefix"))
        .agg(F.count("*").alias("hashes"), F.sum("n").alias("file_count"))
        .filter("hashes > 1")
    )
