"""All hashes of a file in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.functions import codec


def wide_index(index: DataFrame) -> DataFrame:
    """``(file_id, hashes map<algo,hash>)`` with the supported algorithms of a file.

    One fixed-size aggregate per algorithm: it combines before the shuffle and
    needs no list per file.
    """
    columns = [F.max(F.when(F.col("algo") == a, F.col("hash"))).alias(a) for a in ALGOS]
    wide = index.groupBy("file_id").agg(*columns)
    hashes = F.map_from_arrays(codec.names(ALGOS), F.array(*[f"`{a}`" for a in ALGOS]))
    return wide.select(
        "file_id", F.map_filter(hashes, lambda _, v: v.isNotNull()).alias("hashes")
    )


def known_hashes(indexed: Column, packed: Column) -> Column:
    """Index hashes, completed from the packed column where the index has none."""
    legacy = codec.parse_checksums(packed, ALGOS)
    return codec.let(
        F.coalesce(indexed, F.create_map().cast("map<string,string>")),
        lambda have: F.map_concat(
            have, F.map_filter(legacy, lambda k, _: ~F.map_contains_key(have, k))
        ),
    )
