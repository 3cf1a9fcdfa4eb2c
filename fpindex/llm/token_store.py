"""Token ids of documents in Parquet files for selective reads.

A row is a document: ``doc_id, text_key, part, local_start, n_tokens, tokens``.
Rows are in ascending id order, over the files as within them. Row groups and
pages are small, the ids of tokens are dictionary or delta encoded, all other
columns delta encoded; Parquet's column and offset indexes let a reader fetch
the tokens of a few documents, or the lengths of all, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.llm.bpe import encoder, shared_tokenizer
from fpindex.llm.texts import BATCH_BYTES, small_batches

#: Token list columns are written in row groups and pages of about these sizes.
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 16 << 20, 128 << 10, 500


def _encoding(load, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, done = load(), 0
        for batch in small_batches(batches, "text", BATCH_BYTES):
            ids, bounds = bpe.encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    batch.column("part"),
                    pa.array(done + bounds[:-1], pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32))),
                ],
                names=["doc_id", "text_key", "part", "local_start", "n_tokens", "tokens"],
            )
            done += int(bounds[-1])

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = 2,
    encoding: str = "dictionary",
    id: str = "doc_id",
    text: str = "text",
) -> None:
    """Encode whole texts, append ``end_id`` to each, and write them to ``path``.

    A null text counts as empty and gives the end id alone. Null ids come
    first; rows that repeat an id are ordered by a hash of their text. The
    texts are shuffled once, by ranges of id and text hash, so that no id is
    too frequent. ``encoding`` is ``dictionary`` or ``delta``.
    """
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding: {encoding}")
    load = encoder(shared_tokenizer(docs.sparkSession, tokenizer))
    kind = docs.schema[id].dataType.simpleString()
    ordered = (
        docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))
        .repartitionByRange("doc_id", "text_key")
        .sortWithinPartitions("doc_id", "text_key")
        .withColumn("part", F.spark_partition_id())
    )
    tokens = ordered.mapInArrow(
        _encoding(load, end_id),
        f"doc_id {kind}, text_key long, part int, local_start long, n_tokens long, tokens array<int>",
    )
    plain = {f"parquet.enable.dictionary#{c}": "false" for c in tokens.columns[:-1]}
    tokens.write.options(
        **plain,
        **{
            "compression": "zstd",
            "parquet.writer.version": "PARQUET_2_0",
            "parquet.enable.dictionary#tokens.list.element": str(encoding == "dictionary").lower(),
            "parquet.block.size": str(ROW_GROUP_BYTES),
            "parquet.page.size": str(PAGE_BYTES),
            "parquet.page.row.count.limit": str(PAGE_ROWS),
        },
    ).parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, text_key, start, n_tokens`` of all documents; no token is read.

    ``start`` is the number of ids of all documents before. Only one total per
    file reaches the driver.
    """
    return with_starts(spark, path, spark.read.parquet(path).drop("tokens"))


def with_starts(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Rows of a token store with ``start`` in place of ``part`` and ``local_start``."""
    totals = (
        spark.read.parquet(path)
        .groupBy("part")
        .agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
        .orderBy("part")
        .collect()
    )
    ends = np.cumsum([r["n"] for r in totals], dtype=np.int64)
    offsets = [(r["part"], int(e) - r["n"]) for r, e in zip(totals, ends)]
    before = spark.createDataFrame(offsets, "part int, before long")
    return (
        rows.join(F.broadcast(before), "part")
        .withColumn("start", F.col("before") + F.col("local_start"))
        .drop("part", "local_start", "before")
    )


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents with ids from ``first`` to ``last`` and their tokens.

    The bounds are pushed to the files, whose page indexes then skip all other pages.
    """
    rows = spark.read.parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.filter(F.col("doc_id") <= last)
    return rows.select("doc_id", "n_tokens", "tokens")


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        bounds = np.asarray(lists.offsets, np.int64)
        raw = memoryview(np.ascontiguousarray(np.asarray(lists.values), "<u4")).cast("B")
        sums = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sums, pa.int64())],
            names=[*batch.schema.names[:-1], "ids_crc32"],
        )


def token_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    The checksum is the unsigned CRC-32 of the ids as little-endian unsigned
    32-bit integers.
    """
    rows = spark.read.parquet(path).select("doc_id", "part", "local_start", "n_tokens", "tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()
    summed = rows.mapInArrow(
        _checksums, f"doc_id {kind}, part int, local_start long, n_tokens long, ids_crc32 long"
    )
    return with_starts(spark, path, summed).select("doc_id", "start", "n_tokens", "ids_crc32")
