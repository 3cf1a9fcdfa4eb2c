"""File inventories: tables, directory trees and their listings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex import schemas
from fpindex.functions.globs import glob_match
from fpindex.functions.paths import relative_path
from fpindex.session import cut_lineage


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Inventory table; columns a query does not use are never read."""
    return spark.read.schema(schemas.FILES).parquet(path)


_LISTING = "uri string, is_file boolean, size long, mtime long"


def _list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            filesystem, path = fs.FileSystem.from_uri(folder)
            entries = filesystem.get_file_info(fs.FileSelector(path, allow_not_found=True))
            stem = folder.rstrip("/") + "/"
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([stem + e.base_name for e in entries], pa.string()),
                    pa.array([e.type == fs.FileType.File for e in entries], pa.bool_()),
                    pa.array([e.size or 0 for e in entries], pa.int64()),
                    pa.array([int(e.mtime.timestamp()) if e.mtime else 0 for e in entries], pa.int64()),
                ],
                names=["uri", "is_file", "size", "mtime"],
            )


def walk_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Recursive listing of a directory tree, files only, empty ones included.

    Every level of the tree is one job in which the tasks list the folders of
    that level. ``glob`` is matched against the path below ``root``.
    """
    root = canonical_uri(root)
    folders = spark.createDataFrame([(root,)], "uri string")
    levels = []
    while True:
        listed = cut_lineage(folders.repartition("uri").mapInArrow(_list_folders, _LISTING))
        levels.append(listed.filter("is_file"))
        folders = listed.filter("NOT is_file").select("uri")
        if folders.isEmpty():
            break
    files = reduce(DataFrame.unionByName, levels).select(
        F.xxhash64("uri").alias("fileid"),
        "uri",
        relative_path(F.col("uri"), F.lit(root)).alias("path"),
        F.substring_index("uri", "/", -1).alias("name"),
        "size",
        "mtime",
    )
    return files if glob is None else files.filter(glob_match(F.col("path"), glob))


def read_contents(
    spark: SparkSession, root: str, max_bytes: int | None = None, name_glob: str | None = None
) -> DataFrame:
    """Contents ``(file_id, uri, content)`` of the non-empty files of a tree, as rows.

    The size limit is pushed into the listing, so larger files are not opened;
    hash those with ``fpindex.sources.content.StoredFiles``. The underlying
    source skips empty files, which a listing by :func:`walk_files` has.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name_glob is not None:
        reader = reader.option("pathGlobFilter", name_glob)
    files = reader.load(root)
    if max_bytes is not None:
        files = files.filter(F.col("length") <= max_bytes)
    uri = F.regexp_replace("path", "^file:/+", "file:///")
    return files.select(F.xxhash64(uri).alias("file_id"), uri.alias("uri"), "content")


def canonical_uri(root: str) -> str:
    """URI of a folder; a plain path is a local one."""
    if root.startswith("/"):
        root = "file://" + root
    return re.sub("^file:/+", "file:///", root).rstrip("/")


def only_files(inventory: DataFrame) -> DataFrame:
    """Drop folder rows of an inventory that marks them with ``is_file``."""
    return inventory.filter(F.col("is_file")) if "is_file" in inventory.columns else inventory


def scan_inventory(inventory: DataFrame) -> DataFrame:
    """Narrow file listing: identity, place, size and time."""
    return only_files(inventory).select("fileid", "storage", "path", "name", "size", "mtime")
