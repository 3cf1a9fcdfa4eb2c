"""Checking recorded hashes against the contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, ERR_NO_CONTENT, HOT_GROUP_ROWS
from fpindex.operators.duplicates import KEYS
from fpindex.operators.joins import join_groups
from fpindex.operators.rehash import Content, digest_plan
from fpindex.session import cut_lineage
from fpindex.sources.content import StoredFiles


def verify_members(
    members: DataFrame,
    content: Content,
    algos: Sequence[str] = ALGOS,
) -> DataFrame:
    """Member rows with ``verified_hash``, ``verified`` and ``verify_error``.

    ``members`` has ``algo, hash_value`` and ``file_id`` or ``fileid``; it is
    computed once. Hashes are always recomputed and nothing is stored; a file
    that cannot be read is a mismatch.
    """
    key = "fileid" if "fileid" in members.columns else "file_id"
    members = cut_lineage(members)
    if isinstance(content, StoredFiles):
        # at most one entry per algorithm
        plan = members.groupBy(F.col(key).alias("file_id")).agg(F.collect_set("algo").alias("needed"))
    else:
        plan = members.select(F.col(key).alias("file_id"), F.array("algo").alias("needed"))
    digests = digest_plan(plan, content, algos)
    made = F.try_element_at("digests", F.col("algo"))
    return (
        members.join(digests.withColumnRenamed("file_id", key), key, "left")
        .withColumn("verified_hash", made)
        .drop("digests")
        .withColumn("verified", F.coalesce(F.col("verified_hash") == F.col("hash_value"), F.lit(False)))
        .withColumn(
            "verify_error", F.when(F.col("verified_hash").isNull(), F.lit(ERR_NO_CONTENT))
        )
    )


def verify_groups(verified: DataFrame) -> DataFrame:
    """Groups with ``match_count`` and ``mismatch_count``."""
    return verified.groupBy(*KEYS, "file_count").agg(
        F.count_if("verified").alias("match_count"),
        F.count_if(~F.col("verified")).alias("mismatch_count"),
    )


def with_group_counts(verified: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Verified member rows together with the counts of their group.

    The members are computed once, so that contents are not read twice.
    """
    key = "fileid" if "fileid" in verified.columns else "file_id"
    verified = cut_lineage(verified)
    groups = verify_groups(verified)
    return join_groups(
        verified.drop("file_count"), groups, KEYS, "file_count", key, hot_rows
    )


def verified_only(groups: DataFrame) -> DataFrame:
    """Groups all of whose members were verified; unchecked groups are dropped."""
    return groups.filter(F.coalesce("mismatch_count", F.lit(1)) == 0)


def matching_only(groups: DataFrame) -> DataFrame:
    """Groups without a known mismatch; unchecked groups stay."""
    return groups.filter(F.coalesce("mismatch_count", F.lit(0)) == 0)
