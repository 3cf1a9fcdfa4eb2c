"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fpindex.session import ensure_checkpoint_dir


class Scratch:
    """Tables written below ``spark.checkpoint.dir`` instead of being recomputed.

    A stored table survives the loss of executors and cuts the lineage of what
    is built on it. ``drop`` deletes tables that no later step reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self._paths: list[str] = []

    def path(self) -> str:
        """A new path for a table of this run."""
        self._paths.append(f"{self._root}/{len(self._paths)}")
        return self._paths[-1]

    def store(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return the written table."""
        path, schema = self.path(), df.schema
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *keep: DataFrame) -> None:
        """Delete all tables of this run but those that ``keep`` are read from."""
        kept = {f for df in keep for f in df.inputFiles()}
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        conf = self.spark._jsc.hadoopConfiguration()
        for path in self._paths:
            if not any(f"/{path.split('/', 3)[-1].lstrip('/')}/" in f for f in kept):
                place = hadoop(path)
                place.getFileSystem(conf).delete(place, True)
