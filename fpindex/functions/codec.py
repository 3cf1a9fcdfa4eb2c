"""Column expressions for the packed, keyed and JSON hash layouts.

Every function takes and returns Columns, so it stays inside whole-stage code
generation and can be used in any select, filter or join of a table job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fpindex.constants import (
    ALGOS,
    INDEX_VALUE_LENGTH,
    KEY_PREFIX,
    PACKED_MAX_BYTES,
    PENDING_PREFIX,
)

_WELL_FORMED = "^[^:]+:[^:]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def names(values: Sequence[str]) -> Column:
    """Array of plain names as one literal that the optimizer folds."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(",".join(values)), ",")


def _chunks(packed: Column) -> Column:
    return F.filter(F.split(F.coalesce(packed, F.lit("")), " "), lambda p: p != "")


def packed_pairs(packed: Column, algos: Sequence[str] | None = None) -> Column:
    """``ALGO:hex ALGO:hex`` as ``array<struct<algo,hash>>``, one entry per algorithm.

    Algorithms are lower-cased and keep their first position; a repeated one
    takes the last value. Pairs that are not exactly ``algo:value`` are left
    out here and counted by :func:`malformed_pairs`.
    """
    pairs = F.transform(
        F.filter(_chunks(packed), lambda p: p.rlike(_WELL_FORMED)),
        lambda p: F.struct(
            F.lower(F.substring_index(p, ":", 1)).alias("algo"),
            F.substring_index(p, ":", -1).alias("hash"),
        ),
    )
    wanted = None if algos is None else [a.lower() for a in algos]

    def last_of_each(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["algo"]))
        if wanted is not None:
            keys = F.array_intersect(keys, names(wanted))
        return F.transform(
            keys,
            lambda k: F.struct(
                k.alias("algo"),
                F.element_at(F.filter(pairs, lambda p: p["algo"] == k), -1)["hash"].alias("hash"),
            ),
        )

    return let(pairs, last_of_each)


def parse_checksums(packed: Column, algos: Sequence[str] | None = None) -> Column:
    """Packed string as ``map<algo,hash>``; null and ``''`` give an empty map."""
    return F.map_from_entries(packed_pairs(packed, algos))


def malformed_pairs(packed: Column) -> Column:
    """Number of non-empty chunks that are not ``algo:value``."""
    return F.size(F.filter(_chunks(packed), lambda p: ~p.rlike(_WELL_FORMED))).cast("long")


def fit_pairs(pairs: Column, max_bytes: int | None = PACKED_MAX_BYTES) -> Column:
    """Join ``ALGO:hex`` strings in order, leaving out each one that would overflow."""
    if max_bytes is None:
        return F.array_join(pairs, " ")

    def step(acc: Column, pair: Column) -> Column:
        candidate = F.when(acc == "", pair).otherwise(F.concat(acc, F.lit(" "), pair))
        return F.when(F.octet_length(candidate) > max_bytes, acc).otherwise(candidate)

    return F.aggregate(pairs, F.lit(""), step)


def pack_pairs(pairs: Column, max_bytes: int | None = PACKED_MAX_BYTES) -> Column:
    """Pack ``array<struct<algo,hash>>`` in its own order."""
    return fit_pairs(
        F.transform(pairs, lambda p: F.concat(F.upper(p["algo"]), F.lit(":"), p["hash"])),
        max_bytes,
    )


def canonical_pairs(hashes: Column) -> Column:
    """Supported entries of a ``map<algo,hash>`` in canonical order."""
    return let(
        hashes,
        lambda h: F.filter(
            F.transform(
                names(ALGOS), lambda a: F.struct(a.alias("algo"), F.try_element_at(h, a).alias("hash"))
            ),
            lambda p: p["hash"].isNotNull(),
        ),
    )


def pack_checksums(hashes: Column, max_bytes: int | None = PACKED_MAX_BYTES) -> Column:
    """Pack a ``map<algo,hash>`` in canonical order."""
    return pack_pairs(canonical_pairs(hashes), max_bytes)


def merge_pairs(new: Column, existing: Column) -> Column:
    """New pairs first, then the existing pairs whose algorithm is not supplied."""
    supplied = F.transform(new, lambda p: F.lower(p["algo"]))
    return F.concat(
        new,
        let(supplied, lambda s: F.filter(existing, lambda p: ~F.array_contains(s, p["algo"]))),
    )


def rewrite_packed(
    new: Column,
    existing_packed: Column,
    keep_additional: bool = False,
    max_bytes: int | None = PACKED_MAX_BYTES,
) -> Column:
    """Packed string after storing ``new`` pairs over ``existing_packed``."""
    if not keep_additional:
        return pack_pairs(new, max_bytes)
    return pack_pairs(merge_pairs(new, packed_pairs(existing_packed)), max_bytes)


def hash_key(algo: Column) -> Column:
    return F.concat(F.lit(KEY_PREFIX), F.lower(algo))


def algo_from_key(key: Column) -> Column:
    return F.replace(key, F.lit(KEY_PREFIX), F.lit(""))


def parse_mode(status: Column) -> Column:
    """Queue marker without its ``pending:`` prefix."""
    return F.when(
        status.startswith(PENDING_PREFIX), F.substring(status, len(PENDING_PREFIX) + 1, 1 << 20)
    ).otherwise(status)


def index_value(value: Column) -> Column:
    """Value as the legacy index column keeps it."""
    return F.substring(value, 1, INDEX_VALUE_LENGTH)


def iso8601(unix_seconds: Column) -> Column:
    """UTC ISO-8601 text of a unix time, whatever the session time zone is."""
    utc = F.to_utc_timestamp(F.timestamp_seconds(unix_seconds), F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def squeeze(text: Column) -> Column:
    """Text without leading and trailing white space."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalize_algo_list(text: Column) -> Column:
    """Comma list as lower-cased distinct array; ``all`` is every algorithm."""
    listed = F.array_distinct(
        F.filter(F.transform(F.split(text, ","), lambda a: F.lower(squeeze(a))), lambda a: a != "")
    )
    return F.when(F.lower(squeeze(text)) == "all", names(ALGOS)).otherwise(listed)


def normalize_algos(algos: Column) -> Column:
    """Array of names as lower-cased distinct array, order kept."""
    return F.array_distinct(F.transform(algos, lambda a: F.lower(a)))


def supported(algo: Column) -> Column:
    return F.array_contains(names(ALGOS), algo)


def supported_only(algos: Column) -> Column:
    return F.filter(algos, supported)


def missing_algos(packed: Column, requested: Sequence[str]) -> Column:
    """Requested algorithms with no pair in the packed string."""
    wanted = list(dict.fromkeys(a.lower() for a in requested))
    present = F.transform(
        F.filter(_chunks(packed), lambda p: p.contains(":")),
        lambda p: F.lower(F.substring_index(p, ":", 1)),
    )
    return F.array_except(names(wanted), present)
