"""Duplicate reports as JSON or text rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.operators.duplicates import KEYS, PART_FILES, nest_members


def duplicates_to_json(members: DataFrame, part_files: int = PART_FILES) -> DataFrame:
    """One JSON object per group: ``{algo, hash_value, file_count, files: [...]}``.

    A group above ``part_files`` files is written as several objects that say
    which ``part`` they are; together they hold every member.
    """
    columns = [c for c in ("fileid", "path", "name", "owner") if c in members.columns]
    extra = [c for c in ("verified", "verified_hash", "verify_error") if c in members.columns]
    counts = tuple(c for c in ("match_count", "mismatch_count") if c in members.columns)
    nested = nest_members(members, part_files, (*columns, *extra), counts)
    fields = [F.col(c) for c in (*KEYS, "file_count", *counts)]
    several = F.when(F.col("file_count") > part_files, F.col("part")).alias("part")
    return nested.select(
        *KEYS, "part", F.to_json(F.struct(*fields, several, F.col("files"))).alias("json")
    )


def write_duplicates_json(members: DataFrame, path: str, part_files: int = PART_FILES) -> None:
    """JSON lines of all groups."""
    duplicates_to_json(members, part_files).select(F.col("json").alias("value")).write.mode(
        "overwrite"
    ).text(path)


def duplicates_to_lines(members: DataFrame) -> DataFrame:
    """Text report: ``(algo, hash_value, fileid, line)``, the group line having no file."""
    head = members.select(*KEYS, "file_count").distinct().select(
        *KEYS,
        F.lit(None).cast("long").alias("fileid"),
        F.format_string(
            "%s / %s (%d files)", F.upper("algo"), F.col("hash_value"), F.col("file_count")
        ).alias("line"),
    )
    owner = F.when(F.coalesce("owner", F.lit("")) != "", F.format_string("(%s) ", "owner"))
    files = members.select(
        *KEYS,
        "fileid",
        F.concat(
            F.format_string("  [%d] ", "fileid"), F.coalesce(owner, F.lit("")), "path"
        ).alias("line"),
    )
    return head.unionByName(files)
