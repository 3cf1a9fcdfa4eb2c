"""Hashing the files that lack an algorithm in their packed checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import MODE_AUTO, SCOPE_ALL
from fpindex.functions import codec
from fpindex.functions.globs import glob_match
from fpindex.functions.paths import relative_path
from fpindex.operators.ranked import first_rows, ranked
from fpindex.operators.rehash import Content, algo_array, rehash
from fpindex.sources.inventory import only_files

USER_ROOT = "files"


def _matches(path: Column, glob: str | None, base: str) -> Column:
    if glob is None:
        return F.lit(True)
    return glob_match(relative_path(path, F.lit(base)), glob)


def missing_hashes(files: DataFrame, algos: Sequence[str]) -> DataFrame:
    """``(file_id, missing)``: requested algorithms absent from the packed column."""
    return files.select(
        F.col("fileid").alias("file_id"),
        codec.missing_algos(F.col("checksum"), algos).alias("missing"),
    ).filter(F.size("missing") > 0)


def glob_search(files: DataFrame, glob: str, limit: int = 0) -> DataFrame:
    """Files whose path matches; with a positive limit the first by id."""
    hits = only_files(files).filter(glob_match(F.col("path"), glob))
    return first_rows(hits, [F.asc("fileid")], limit) if limit > 0 else hits


def glob_search_page(files: DataFrame, glob: str, limit: int, after: int | Column | None = None) -> DataFrame:
    """One page of the matching files by id, with ``has_more``.

    ``after`` is the last id of the page before, a number or a scalar; the
    search goes on behind it, however many files lie before.
    """
    if limit < 1:
        raise ValueError("a page has 1 row or more")
    rest = only_files(files) if after is None else only_files(files).filter(F.col("fileid") > after)
    hits = ranked(rest.filter(glob_match(F.col("path"), glob)), [F.asc("fileid")])
    return hits.slice(limit).withColumn("has_more", F.lit(hits.total > limit))


def walk_stats(
    files: DataFrame,
    algos: Sequence[str],
    glob: str | None = None,
    by: Sequence[str] = (),
    base: str = USER_ROOT,
) -> DataFrame:
    """Files seen, skipped by the glob, already hashed and to be hashed, in one pass."""
    matched = _matches(F.col("path"), glob, base)
    lacking = F.size(codec.missing_algos(F.col("checksum"), algos)) > 0
    return only_files(files).groupBy(*by).agg(
        F.count("*").alias("files"),
        F.count_if(~matched).alias("glob_skipped"),
        F.count_if(matched & ~lacking).alias("already_hashed"),
        F.count_if(matched & lacking).alias("collected"),
    )


def _in_scope(files: DataFrame, scope: str) -> DataFrame:
    files = only_files(files)
    return files if scope == SCOPE_ALL else files.filter(F.col("owner") == scope)


def candidates(
    files: DataFrame,
    algos: Sequence[str],
    glob: str | None = None,
    scope: str = SCOPE_ALL,
    budget: int | None = None,
    base: str = USER_ROOT,
) -> DataFrame:
    """Files to hash: in scope, matching, lacking an algorithm.

    With a budget, users are served in order of name and files in order of id
    until the budget is used up, whatever the number of users.
    """
    lacking = F.size(codec.missing_algos(F.col("checksum"), algos)) > 0
    found = _in_scope(files, scope).filter(lacking & _matches(F.col("path"), glob, base))
    return found if not budget else first_rows(found, [F.asc("owner"), F.asc("fileid")], budget)


def generate_missing(
    files: DataFrame,
    index: DataFrame,
    state: DataFrame,
    content: Content,
    algos: Sequence[str],
    glob: str | None = None,
    scope: str = SCOPE_ALL,
    budget: int | None = None,
    base: str = USER_ROOT,
) -> DataFrame:
    """Hash what is missing: rows as of ``rehash`` for every candidate."""
    wanted = candidates(files, algos, glob, scope, budget, base).select(
        F.col("fileid").alias("file_id"), algo_array(algos).alias("requested")
    )
    return rehash(wanted, files, index, state, content, algos)


def generate_totals(results: DataFrame) -> DataFrame:
    """``(processed, skipped)`` files: processed if any algorithm was computed."""
    per_file = results.groupBy("file_id").agg(
        F.bool_or(F.col("success") & ~F.col("existed")).alias("hashed")
    )
    return per_file.agg(
        F.count_if("hashed").alias("processed"), F.count_if(~F.col("hashed")).alias("skipped")
    )


def mark_matching(
    files: DataFrame, glob: str = "**", scope: str = SCOPE_ALL, budget: int | None = None
) -> DataFrame:
    """Marks ``(file_id, mode)`` that put matching files into the queue as ``auto``."""
    hits = _in_scope(files, scope).filter(glob_match(F.col("path"), glob))
    if budget:
        hits = first_rows(hits, [F.asc("owner"), F.asc("fileid")], budget)
    return hits.select(F.col("fileid").alias("file_id"), F.lit(MODE_AUTO).alias("mode"))
