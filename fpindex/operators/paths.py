"""Owners, paths and user scopes of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import SCOPE_ALL
from fpindex.functions.paths import owner_from_storage
from fpindex.operators.joins import spread_join


def resolve_paths(files: DataFrame, storages: DataFrame, user: str | None = None) -> DataFrame:
    """``(fileid, path, name, storage_id, owner)``; files of unknown storages are dropped.

    With ``user`` only the files in that user's home storage remain. The filter
    is on the storage name, so it is applied before the join.
    """
    named = storages.select(F.col("numeric_id").alias("storage"), F.col("id").alias("storage_id"))
    if user is not None:
        named = named.filter(F.col("storage_id") == f"home::{user}")
    listed = files.select("fileid", "storage", "path", "name")
    return spread_join(listed, named, "storage", spread_by="fileid").select(
        "fileid",
        "path",
        "name",
        "storage_id",
        owner_from_storage(F.col("storage_id")).alias("owner"),
    )


def with_owner(files: DataFrame, storages: DataFrame) -> DataFrame:
    """All file columns and the owner; null for files of unknown storages."""
    owners = storages.select(
        F.col("numeric_id").alias("storage"), owner_from_storage(F.col("id")).alias("owner")
    )
    return spread_join(files, owners, "storage", spread_by="fileid", how="left")


def visible_files(files: DataFrame, storages: DataFrame, user: str) -> DataFrame:
    """Ids of the files a user sees."""
    return resolve_paths(files, storages, user).select("fileid")


def users_in_scope(storages: DataFrame, scope: str = SCOPE_ALL) -> DataFrame:
    """Users a rule scope covers; an unknown user gives no row."""
    users = storages.select(owner_from_storage(F.col("id")).alias("user")).distinct()
    return users if scope == SCOPE_ALL else users.filter(F.col("user") == scope)


def files_by_path(
    files: DataFrame, storages: DataFrame, wanted: DataFrame, by_user: bool = False
) -> DataFrame:
    """Resolve a table of paths; what is not a file of the inventory has no row.

    ``wanted`` has ``path`` and, with ``by_user``, ``owner``: then the path is
    looked for in that user's storage only.
    """
    keys = ["owner", "path"] if by_user else ["path"]
    resolved = resolve_paths(files, storages).select("fileid", "owner", "path")
    return resolved.join(wanted.select(*keys).distinct(), keys).select("fileid", "owner", "path")
