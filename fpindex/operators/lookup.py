"""Reverse lookups: from a hash to the files that have it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.functions import codec
from fpindex.functions.terms import parse_hash_term
from fpindex.operators.joins import hot_join
from fpindex.operators.paths import resolve_paths, visible_files
from fpindex.session import cut_lineage

DEFAULT_LIMIT = 100


def checked_limit(limit: int | None) -> int | None:
    """The limit as given; numbers below 1 are refused, ``None`` is all."""
    if limit is not None and limit < 1:
        raise ValueError("a limit is 1 or more, or None for all")
    return limit


def paths_of(hits: DataFrame, files: DataFrame, storages: DataFrame, user: str | None) -> DataFrame:
    """Resolved paths of the files in ``hits(fileid)``; the inventory meets the hits first."""
    wanted = hits.select("fileid").distinct()
    return resolve_paths(files.join(wanted, "fileid", "left_semi"), storages, user)


def filter_hash(index: DataFrame, value: str | Column, algo: str | None = None) -> DataFrame:
    """Index rows of one hash; both equalities are pushed to the scan."""
    rows = index.filter(F.col("hash") == value)
    return rows.filter(F.col("algo") == algo.lower()) if algo else rows


def find_by_hash(
    index: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    value: str | Column,
    algo: str | None = None,
    limit: int | None = DEFAULT_LIMIT,
    user: str | None = None,
) -> DataFrame:
    """``(fileid, algo, hash, path, name, has_more)`` of the files with a hash.

    Filters come before the limit, so a page is short only when there are no
    more matches; ``has_more`` tells whether the limit left any out, and
    ``limit=None`` gives all. The hash is a text or a scalar subquery.
    """
    checked_limit(limit)
    if isinstance(value, str):
        value = value.strip().lower()
        if not value:
            raise ValueError("a hash is required")
    hits = filter_hash(index, value, algo).withColumnRenamed("file_id", "fileid")
    found = hits.join(paths_of(hits, files, storages, user), "fileid").select(
        "fileid", "algo", "hash", "path", "name"
    )
    if limit is None:
        return found.withColumn("has_more", F.lit(False))
    # one row more than asked for tells whether there are more
    shown = cut_lineage(found.orderBy("fileid", "algo").limit(limit + 1))
    return shown.orderBy("fileid", "algo").limit(limit).withColumn("has_more", F.lit(shown.count() > limit))


def find_by_hashes(
    index: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    probes: DataFrame,
    user: str | None = None,
) -> DataFrame:
    """Batch form: ``probes(hash[, algo])``, a null algo standing for any.

    Probes are made unique first. One content (the empty file) may be much of a
    store, so the index rows of hot hashes are counted and dealt over as many
    tasks as they need.
    """
    if "algo" not in probes.columns:
        probes = probes.select("hash", F.lit(None).cast("string").alias("algo"))
    wanted = (
        probes.filter(F.col("hash").isNotNull())
        .groupBy(F.lower("hash").alias("hash"))
        .agg(
            F.bool_or(F.col("algo").isNull()).alias("any_algo"),
            # at most one entry per supported algorithm
            F.collect_set(F.when(codec.supported(F.lower("algo")), F.lower("algo"))).alias("algos"),
        )
    )
    hits = (
        hot_join(index, wanted, "hash", spread_by="file_id")
        .filter(F.col("any_algo") | F.array_contains("algos", F.col("algo")))
        .select(F.col("file_id").alias("fileid"), "algo", "hash")
    )
    return hits.join(paths_of(hits, files, storages, user), "fileid").select(
        "fileid", "algo", "hash", "path", "name"
    )


def parse_terms(terms: DataFrame, strict: bool = False) -> DataFrame:
    """``(term, algo, hash)``; both null for text that is no search term."""
    return terms.select("term", parse_hash_term(F.trim("term"), strict).alias("t")).select(
        "term", F.col("t.algo").alias("algo"), F.col("t.hash").alias("hash")
    )


def search_terms(
    index: DataFrame,
    files: DataFrame,
    storages: DataFrame,
    terms: DataFrame,
    user: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Hits of a table of search terms; invalid terms have none."""
    return find_by_hashes(index, files, storages, parse_terms(terms, strict), user)


def hashes_by_file(index: DataFrame, state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(fileid, algo, hash, updated_at)`` in canonical order of algorithms."""
    rows = index.filter(codec.supported(F.col("algo")))
    if ids is not None:
        rows = rows.join(ids.select(F.col("fileid").alias("file_id")).distinct(), "file_id", "left_semi")
    return rows.join(state.select("file_id", "updated_at"), "file_id", "left").select(
        F.col("file_id").alias("fileid"),
        "algo",
        "hash",
        codec.iso8601(F.col("updated_at")).alias("updated_at"),
    )


def hashes_for_user(
    index: DataFrame, state: DataFrame, files: DataFrame, storages: DataFrame, user: str
) -> DataFrame:
    """Hash listing of the files a user sees."""
    return hashes_by_file(index, state, visible_files(files, storages, user))


def canonical_order(algo: str = "algo"):
    """Sort key that puts algorithms in canonical order."""
    return F.array_position(F.array(*map(F.lit, ALGOS)), F.col(algo))


def hash_count_per_file(files: DataFrame, index: DataFrame) -> DataFrame:
    """Number of hashes of every file, 0 included."""
    counts = index.groupBy("file_id").agg(F.count("*").alias("n"))
    return files.select(F.col("fileid").alias("file_id")).join(counts, "file_id", "left").select(
        "file_id", F.coalesce("n", F.lit(0).cast("long")).alias("hash_count")
    )


def scan_like(files: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """Substring scan over the packed column: the unindexed way to look a hash up."""
    rows = files.filter(F.col("checksum").contains(value)).select("fileid", "path", "checksum")
    return rows if limit is None else rows.orderBy("fileid").limit(limit)
