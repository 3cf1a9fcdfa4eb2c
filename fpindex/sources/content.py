"""Where file contents come from.

A content table ``(file_id, content)`` is digested where it is read. Files of a
store are read by the tasks themselves, in bounded chunks, so an object may be
larger than a row or an executor; only the files a plan asks for are opened.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.functions.combine import EMPTY, Part, hex_checksums, joined, part_of
from fpindex.functions.digests import checked_algos, hex_digests

CHUNK_BYTES = 8 << 20
#: Bytes of an object that one task reads when checksums are computed by ranges.
RANGE_BYTES = 1 << 30


def _chunks(uri: str, size: int) -> Iterator[bytes]:
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_stream(path) as stream:
        while chunk := stream.read(size):
            yield chunk


@dataclass(frozen=True)
class StoredFiles:
    """Contents addressed by URI: ``locations(file_id, uri)``."""

    locations: DataFrame
    chunk_bytes: int = CHUNK_BYTES
    partitions: int | None = None


def digest_stored(
    plan: DataFrame,
    files: StoredFiles,
    algos: Sequence[str] = ALGOS,
) -> DataFrame:
    """Digests of stored files: ``(file_id, digests, read_error)``.

    ``plan`` has ``file_id`` and, optionally, ``needed`` (array of algorithms).
    The rows that are shuffled hold a path each; contents stay in their task.
    """
    algos = checked_algos(algos)
    size = files.chunk_bytes
    if "needed" not in plan.columns:
        plan = plan.withColumn("needed", F.array(*map(F.lit, algos)))
    work = plan.select("file_id", "needed").join(
        files.locations.select("file_id", "uri"), "file_id"
    )
    # one heavy file is one unit of work, so paths are dealt out evenly
    work = work.repartition(files.partitions) if files.partitions else work.repartition("file_id")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                wanted = [a for a in algos if a in row["needed"]]
                digests, error = [], None
                try:
                    digests = list(zip(wanted, hex_digests(_chunks(row["uri"], size), wanted)))
                except (OSError, pa.ArrowException) as problem:
                    error = str(problem)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file_id"]], pa.int64()),
                        pa.array([digests], pa.map_(pa.string(), pa.string())),
                        pa.array([error], pa.string()),
                    ],
                    names=["file_id", "digests", "read_error"],
                )

    return work.mapInArrow(read, "file_id long, digests map<string,string>, read_error string")


def _ranges(size: int):
    """Ranges of the objects, or one row with the error."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                error, length = None, 0
                try:
                    filesystem, path = fs.FileSystem.from_uri(row["uri"])
                    info = filesystem.get_file_info(path)
                    length, error = (info.size, None) if info.is_file else (0, "no such file")
                except (OSError, pa.ArrowException) as problem:
                    error = str(problem)
                starts = list(range(0, length or 1, size))
                yield pa.RecordBatch.from_pydict(
                    {
                        "file_id": [row["file_id"]] * len(starts),
                        "uri": [row["uri"]] * len(starts),
                        "start": starts,
                        "error": pa.array([error] * len(starts), pa.string()),
                    }
                )

    return cut


def _range_chunks(uri: str, start: int, size: int, chunk: int) -> Iterator[bytes]:
    filesystem, path = fs.FileSystem.from_uri(uri)
    with filesystem.open_input_file(path) as file:
        file.seek(start)
        left = size
        while left and (data := file.read(min(left, chunk))):
            left -= len(data)
            yield data


def _read_ranges(size: int, chunk: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, error = EMPTY, row["error"]
                if error is None:
                    try:
                        part = part_of(_range_chunks(row["uri"], row["start"], size, chunk))
                    except (OSError, pa.ArrowException) as problem:
                        error = str(problem)
                yield pa.RecordBatch.from_pydict(
                    {
                        "file_id": pa.array([row["file_id"]], pa.int64()),
                        "start": pa.array([row["start"]], pa.int64()),
                        "adler": pa.array([part.adler], pa.int64()),
                        "crc": pa.array([part.crc], pa.int64()),
                        "length": pa.array([part.length], pa.int64()),
                        "error": pa.array([error], pa.string()),
                    }
                )

    return read


def checksum_stored(plan: DataFrame, files: StoredFiles, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """adler32 and crc32 of stored objects of any size: ``(file_id, digests, read_error)``.

    An object is read in ranges by as many tasks, and the checksums of its
    ranges are joined; a row per range is all that is shuffled. If a range
    cannot be read, the object has no digests but the error.
    """
    wanted = plan.select("file_id").distinct().join(files.locations.select("file_id", "uri"), "file_id")
    ranges = wanted.mapInArrow(_ranges(range_bytes), "file_id long, uri string, start long, error string")
    dealt = ranges.repartition(files.partitions) if files.partitions else ranges.repartition("file_id", "start")
    parts = dealt.mapInArrow(
        _read_ranges(range_bytes, files.chunk_bytes),
        "file_id long, start long, adler long, crc long, length long, error string",
    )
    # an object has as many parts as ranges, which its size bounds
    listed = parts.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "adler", "crc", "length"))).alias("parts"), F.max("error").alias("read_error")
    )

    @F.arrow_udf("map<string,string>")
    def whole(lists: pa.Array) -> pa.Array:
        made = []
        for rows in lists.to_pylist():
            total = EMPTY
            for r in rows:
                total = joined(total, Part(r["adler"], r["crc"], r["length"]))
            made.append(list(hex_checksums(total).items()))
        return pa.array(made, pa.map_(pa.string(), pa.string()))

    return listed.select(
        "file_id", F.when(F.col("read_error").isNull(), whole("parts")).alias("digests"), "read_error"
    )
