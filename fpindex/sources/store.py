"""Writing the index and the packed mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex import schemas
from fpindex.constants import PACKED_MAX_BYTES
from fpindex.functions import codec
from fpindex.operators.wide import wide_index


def write_index(index: DataFrame, path: str, partitions: int | None = None) -> None:
    """Store the index so that a hash equality skips nearly all of it.

    Rows are range-partitioned and sorted by hash, with the id last so that one
    very common hash still spreads over several files; min/max statistics and a
    Bloom filter on ``hash`` then prune files and row groups.
    """
    keys = ["hash", "algo", "file_id"]
    laid_out = (
        index.repartitionByRange(partitions, *keys)
        if partitions
        else index.repartitionByRange(*keys)
    )
    (
        laid_out.sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("parquet.bloom.filter.enabled#hash", "true")
        .parquet(path)
    )


def write_index_table(
    index: DataFrame, table: str, buckets: int, by: str = "file_id"
) -> None:
    """Store the index as a bucketed table.

    By ``file_id`` the pipelines join it without a shuffle; by ``hash`` duplicate
    groups are counted without one.
    """
    others = [c for c in ("file_id", "hash", "algo") if c != by]
    (
        index.write.mode("overwrite")
        .bucketBy(buckets, by)
        .sortBy(by, *others)
        .saveAsTable(table)
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HASH_INDEX).parquet(path)


def with_packed_mirror(
    files: DataFrame,
    index: DataFrame,
    keep_additional: bool = False,
    max_bytes: int | None = PACKED_MAX_BYTES,
) -> DataFrame:
    """Inventory whose packed column mirrors the index.

    Files without index rows keep their string. With ``keep_additional``,
    algorithms only the old string knows are kept behind the new ones.
    """
    hashes = wide_index(index).withColumnRenamed("file_id", "fileid")
    packed = codec.rewrite_packed(
        codec.canonical_pairs(F.col("hashes")), F.col("checksum"), keep_additional, max_bytes
    )
    return files.join(hashes, "fileid", "left").select(
        *[c for c in files.columns if c != "checksum"],
        F.when(F.col("hashes").isNotNull(), packed).otherwise(F.col("checksum")).alias("checksum"),
    )
