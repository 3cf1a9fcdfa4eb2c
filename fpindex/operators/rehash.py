"""Which hashes are missing, and computing them.

A plan row says what one file needs. Contents are never shuffled: the plan goes
to where they are read (see ``fpindex.operators.asked``), the asked digests are
computed there, and only those are joined with the plan. A plan over stored
files opens those files in its own tasks. Plans are cut once, since they are
read for that filter and for the join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import (
    ALGOS,
    DEFAULT_ALGO,
    ERR_NO_CONTENT,
    ERR_NOT_FILE,
    ERR_NOT_FOUND,
    ERR_UNSUPPORTED,
)
from fpindex.functions import codec
from fpindex.functions.digests import with_digests
from fpindex.operators.asked import IdFilter, id_filter, reduce_tables
from fpindex.operators.wide import known_hashes, wide_index
from fpindex.operators.rules import fresh
from fpindex.session import cut_lineage
from fpindex.sources.content import StoredFiles, digest_stored

Content = DataFrame | StoredFiles

NO_HASHES = "map<string,string>"


def algo_array(algos: Sequence[str]) -> Column:
    return codec.names(list(dict.fromkeys(a.lower() for a in algos)))


def file_facts(files: DataFrame, index: DataFrame, state: DataFrame) -> DataFrame:
    """``(file_id, mtime, is_file, updated_at, known)``, one row per file.

    Everything is joined on the file id, so each table is shuffled once.
    """
    is_file = F.col("is_file") if "is_file" in files.columns else F.lit(True)
    return (
        files.select(
            F.col("fileid").alias("file_id"), "mtime", "checksum", is_file.alias("is_file")
        )
        .join(state.select("file_id", "updated_at"), "file_id", "left")
        .join(wide_index(index), "file_id", "left")
        .select(
            "file_id",
            "mtime",
            "is_file",
            "updated_at",
            known_hashes(F.col("hashes"), F.col("checksum")).alias("known"),
        )
    )


def needed_of(requested: Column, known: Column, is_fresh: Column, skip_existing: bool) -> Column:
    """Supported requested algorithms that are not both known and fresh."""
    valid = codec.supported_only(requested)
    if not skip_existing:
        return valid
    return F.filter(valid, lambda a: ~(is_fresh & F.map_contains_key(known, a)))


def needed_hashes(
    files: DataFrame,
    index: DataFrame,
    state: DataFrame,
    algos: Sequence[str] = ALGOS,
    skip_existing: bool = True,
) -> DataFrame:
    """``(file_id, algo)`` still to be computed."""
    facts = file_facts(files, index, state).filter("is_file")
    is_fresh = fresh(F.col("updated_at"), F.col("mtime"))
    needed = needed_of(algo_array(algos), F.col("known"), is_fresh, skip_existing)
    return facts.select("file_id", F.explode_outer(needed).alias("algo")).filter(
        F.col("algo").isNotNull()
    )


def asked_contents(content: DataFrame, asked: IdFilter) -> DataFrame:
    """``(file_id, content, needed)`` of the readable contents that a plan asks for.

    A few rows more may come, and a few algorithms more be named: false
    positives of the filter.
    """
    return asked.asked(content.select("file_id", "content").filter(F.col("content").isNotNull()))


def digest_plan(
    plan: DataFrame, content: Content, algos: Sequence[str] = ALGOS, within: IdFilter | None = None
) -> DataFrame:
    """``(file_id, digests)`` of the files in ``plan(file_id, needed)``.

    One way for plans of all sizes. Join the result with the plan, which is
    read twice before: cut its lineage first. Digests that were not asked for
    may be among them. ``within`` is a filter that covers the plan's files.
    """
    algos = [a for a in ALGOS if a in set(algos)]
    work = plan.select("file_id", "needed").filter(F.size("needed") > 0)
    if isinstance(content, StoredFiles):
        return digest_stored(work, content, algos).drop("read_error")
    if not algos:
        return work.limit(0).select("file_id", F.create_map().cast(NO_HASHES).alias("digests"))
    asked = asked_contents(content, id_filter(work, algos, "needed", within=within))
    return with_digests(asked, "content", algos, needed="needed").select("file_id", "digests")


def with_results(
    rows: DataFrame, content: Content, algos: Sequence[str] = ALGOS, within: IdFilter | None = None
) -> DataFrame:
    """Add ``results``: one ``struct<algo,success,hash,existed,error>`` per requested algorithm.

    ``rows`` has ``file_id, found, is_file, requested, needed, known``.
    """
    rows = cut_lineage(rows)
    digests = digest_plan(rows, content, algos, within)
    joined = rows.join(digests, "file_id", "left")

    def result(algo: Column) -> Column:
        stored = F.try_element_at(F.col("known"), algo)
        made = F.try_element_at(F.col("digests"), algo)
        existed = ~F.array_contains("needed", algo)
        error = (
            F.when(~codec.supported(algo), F.concat(F.lit(ERR_UNSUPPORTED), algo))
            .when(~F.col("found"), F.lit(ERR_NOT_FOUND))
            .when(~F.col("is_file"), F.lit(ERR_NOT_FILE))
            .when(~existed & made.isNull(), F.lit(ERR_NO_CONTENT))
        )
        return F.struct(
            algo.alias("algo"),
            error.isNull().alias("success"),
            F.when(error.isNotNull(), F.lit(""))
            .otherwise(F.when(existed, stored).otherwise(made))
            .alias("hash"),
            (error.isNull() & existed).alias("existed"),
            error.alias("error"),
        )

    return joined.withColumn("results", F.transform("requested", result)).drop("digests")


def plan_requests(
    requests: DataFrame,
    files: DataFrame,
    index: DataFrame,
    state: DataFrame,
    skip_existing: bool = True,
) -> DataFrame:
    """Requests ``(file_id, requested)`` with what is known and what is needed."""
    facts = file_facts(files, index, state).withColumn("found", F.lit(True))
    rows = requests.select("file_id", codec.normalize_algos(F.col("requested")).alias("requested"))
    rows = rows.join(facts, "file_id", "left").select(
        "file_id",
        "requested",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("is_file", F.lit(False)).alias("is_file"),
        F.coalesce("known", F.create_map().cast(NO_HASHES)).alias("known"),
        fresh(F.col("updated_at"), F.col("mtime")).alias("fresh"),
    )
    needed = needed_of(F.col("requested"), F.col("known"), F.col("fresh"), skip_existing)
    usable = F.col("found") & F.col("is_file")
    return rows.withColumn("needed", F.when(usable, needed).otherwise(F.slice("requested", 1, 0)))


def rehash(
    requests: DataFrame,
    files: DataFrame,
    index: DataFrame,
    state: DataFrame,
    content: Content,
    algos: Sequence[str] = ALGOS,
    skip_existing: bool = True,
) -> DataFrame:
    """``(file_id, algo, success, hash, existed, error)`` per requested algorithm.

    ``requests`` has one row per file; ``algos`` names every supported algorithm
    that any of them may ask for. Inventory, index and state are reduced to the
    requested files where they are read.
    """
    requests = cut_lineage(requests.filter(F.col("file_id").isNotNull()))
    wanted = id_filter(requests)
    files, index, state = reduce_tables(wanted, files, index, state)
    rows = plan_requests(requests, files, index, state, skip_existing)
    return _result_rows(with_results(rows, content, algos, wanted))


def _result_rows(done: DataFrame) -> DataFrame:
    return done.select("file_id", F.inline_outer("results")).filter(F.col("algo").isNotNull())


def request_all(ids: DataFrame, algos: Sequence[str]) -> DataFrame:
    """The same algorithms for every file of ``ids(file_id)``."""
    return ids.select("file_id").distinct().withColumn("requested", algo_array(algos))


def recalc_existing(
    files: DataFrame,
    index: DataFrame,
    state: DataFrame,
    content: Content,
) -> DataFrame:
    """Recompute the algorithms each file has already; the default one if none."""
    have = files.select(F.col("fileid").alias("file_id")).join(wide_index(index), "file_id", "left")
    listed = F.map_keys("hashes")
    requests = have.select(
        "file_id",
        F.when(F.coalesce(F.size(listed), F.lit(0)) > 0, listed)
        .otherwise(algo_array([DEFAULT_ALGO]))
        .alias("requested"),
    )
    rows = plan_requests(requests, files, index, state)
    return _result_rows(with_results(rows, content, ALGOS))


def new_index_rows(results: DataFrame) -> DataFrame:
    """Index rows of the hashes that were computed."""
    return results.filter("success AND NOT existed").select("file_id", "algo", "hash")


def replace_index_rows(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Index with the given (file, algo) rows replaced or added."""
    kept = index.join(rows.select("file_id", "algo"), ["file_id", "algo"], "left_anti")
    return kept.unionByName(rows)
