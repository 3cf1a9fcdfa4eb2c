"""Import and export of the legacy hash layouts.

Imports give rows of ``hash_index`` and ``hash_state``; what cannot be read is
returned by the matching ``quarantine_*`` job instead of being lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import (
    HEX_LENGTH,
    INDEX_VALUE_LENGTH,
    KEY_PREFIX,
    KEY_UPDATED_AT,
    PACKED_MAX_BYTES,
    PENDING_PREFIX,
)
from fpindex.functions import codec
from fpindex.operators.wide import wide_index


def import_packed(files: DataFrame, id_col: str = "fileid", packed_col: str = "checksum") -> DataFrame:
    """Index rows of the packed checksum column; unknown algorithms are left out."""
    pairs = codec.packed_pairs(F.col(packed_col))
    return (
        files.select(F.col(id_col).alias("file_id"), F.inline_outer(pairs))
        .filter(codec.supported(F.col("algo")))
        .select("file_id", "algo", "hash")
    )


def quarantine_packed(
    files: DataFrame, id_col: str = "fileid", packed_col: str = "checksum"
) -> DataFrame:
    """Rows with malformed pairs or unknown algorithms, with their number."""
    packed = F.col(packed_col)
    unknown = F.size(F.filter(codec.packed_pairs(packed), lambda p: ~codec.supported(p["algo"])))
    bad = codec.malformed_pairs(packed) + unknown.cast("long")
    return files.select(
        F.col(id_col).alias("file_id"), packed.alias("packed"), bad.alias("bad_pairs")
    ).filter("bad_pairs > 0")


def metadata_entries(json: Column) -> Column:
    """A file's JSON document as ``map<key,text>``; null, empty or malformed gives ``{}``."""
    return F.coalesce(
        F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>")
    )


def entry_value(entry: Column) -> Column:
    """Value of one document entry in object, array or bare form."""
    return (
        F.when(entry.startswith("{"), F.get_json_object(entry, "$.value"))
        .when(entry.startswith("["), F.get_json_object(entry, "$[0]"))
        .otherwise(entry)
    )


def extract_authoritative(json: Column, key: Column) -> Column:
    """``struct<algo,hash>`` the document holds for a key; hash null if absent."""
    return F.struct(
        codec.algo_from_key(key).alias("algo"),
        entry_value(F.try_element_at(metadata_entries(json), key)).alias("hash"),
    )


def import_json(documents: DataFrame) -> DataFrame:
    """Index rows of ``(file_id, json)`` documents."""
    return (
        documents.select("file_id", F.explode_outer(metadata_entries(F.col("json"))))
        .filter(F.col("key").startswith(KEY_PREFIX) & (F.col("key") != KEY_UPDATED_AT))
        .select(
            "file_id",
            codec.algo_from_key(F.col("key")).alias("algo"),
            entry_value(F.col("value")).alias("hash"),
        )
        .filter(F.col("hash").isNotNull())
    )


def quarantine_json(documents: DataFrame) -> DataFrame:
    """Documents that are not JSON objects."""
    return documents.filter(
        (F.coalesce("json", F.lit("")) != "")
        & F.from_json(F.col("json"), "map<string,string>").isNull()
    ).select("file_id", "json")


def _is_hash_key(key: Column) -> Column:
    return key.startswith(KEY_PREFIX) & (key != KEY_UPDATED_AT)


def _eav_hashes(eav: DataFrame, documents: DataFrame | None) -> DataFrame:
    """Hash rows of the key/value index with ``hash``: the full value, or null if it is nowhere.

    Stored values are cut to 63 characters, so a document's value comes first.
    """
    keys = eav.filter(_is_hash_key(F.col("meta_key"))).withColumn(
        "algo", codec.algo_from_key(F.col("meta_key"))
    )
    stored = F.col("meta_value_string")
    if documents is None:
        value = stored
    else:
        keys = keys.join(documents.select("file_id", "json"), "file_id", "left")
        value = F.coalesce(extract_authoritative(F.col("json"), F.col("meta_key"))["hash"], stored)
    length = F.lit(None).cast("int")
    for algo, n in HEX_LENGTH.items():
        length = F.when(F.col("algo") == algo, n).otherwise(length)
    return keys.withColumn("hash", F.when(F.length(value) == length, value))


def import_eav(eav: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Index rows of the key/value index, full hashes only; see :func:`quarantine_eav`."""
    return _eav_hashes(eav, documents).filter("hash IS NOT NULL").select("file_id", "algo", "hash")


def quarantine_eav(eav: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Hash rows whose full value is neither in the index nor in a document."""
    return (
        _eav_hashes(eav, documents)
        .filter("hash IS NULL")
        .select("file_id", "meta_key", "meta_value_string")
    )


def import_eav_full(eav: DataFrame, documents: DataFrame) -> DataFrame:
    """Index rows with the full hash, taken from the documents where they have one."""
    keys = eav.filter(_is_hash_key(F.col("meta_key")))
    found = extract_authoritative(F.col("json"), F.col("meta_key"))
    return keys.join(documents.select("file_id", "json"), "file_id").select(
        "file_id", found["algo"].alias("algo"), found["hash"].alias("hash")
    ).filter(F.col("hash").isNotNull())


def import_eav_state(eav: DataFrame) -> DataFrame:
    """State rows of the key/value index."""
    marker = F.col("meta_value_string")
    return eav.filter(F.col("meta_key") == KEY_UPDATED_AT).select(
        "file_id",
        F.col("meta_value_int").alias("updated_at"),
        F.when(marker.startswith(PENDING_PREFIX), codec.parse_mode(marker)).alias("pending_mode"),
    )


def lookup_truncated(
    eav: DataFrame, documents: DataFrame, value: str, algo: str | None = None
) -> DataFrame:
    """Reverse lookup on the key/value index, rechecked against the full hash."""
    value = value.strip().lower()
    rows = eav.filter(F.col("meta_value_string") == value[:INDEX_VALUE_LENGTH])
    if algo:
        rows = rows.filter(F.col("meta_key") == KEY_PREFIX + algo.lower())
    return import_eav_full(rows, documents).filter(F.col("hash") == value)


def export_packed(index: DataFrame, max_bytes: int | None = PACKED_MAX_BYTES) -> DataFrame:
    """Packed string of every file in the index; ``max_bytes=None`` packs all pairs."""
    return wide_index(index).select(
        "file_id", codec.pack_checksums(F.col("hashes"), max_bytes).alias("checksum")
    )


def packed_dropped(index: DataFrame, max_bytes: int = PACKED_MAX_BYTES) -> DataFrame:
    """Index rows that :func:`export_packed` leaves out because they do not fit."""
    wide = wide_index(index)
    kept = codec.parse_checksums(codec.pack_checksums(F.col("hashes"), max_bytes))
    left_out = F.filter(codec.canonical_pairs(F.col("hashes")), lambda p: ~F.map_contains_key(F.col("kept"), p["algo"]))
    return wide.withColumn("kept", kept).select("file_id", F.inline(left_out))


def export_eav(index: DataFrame, state: DataFrame) -> DataFrame:
    """Key/value rows of the index and the state."""
    none = F.lit(None)
    hashes = index.select(
        "file_id",
        codec.hash_key(F.col("algo")).alias("meta_key"),
        codec.index_value(F.col("hash")).alias("meta_value_string"),
        none.cast("long").alias("meta_value_int"),
    )
    markers = state.select(
        "file_id",
        F.lit(KEY_UPDATED_AT).alias("meta_key"),
        F.when(
            F.col("pending_mode").isNotNull(), F.concat(F.lit(PENDING_PREFIX), "pending_mode")
        ).alias("meta_value_string"),
        F.col("updated_at").alias("meta_value_int"),
    )
    return hashes.unionByName(markers)


def export_json(index: DataFrame, state: DataFrame) -> DataFrame:
    """One JSON document per tracked file."""
    def entry(value: Column, kind: str) -> Column:
        return F.struct(
            value.cast("string").alias("value"),
            F.lit(kind).alias("type"),
            F.lit("").alias("etag"),
            F.lit(True).alias("indexed"),
            F.lit(0).alias("editPermission"),
        )

    hashes = F.transform(
        codec.canonical_pairs(F.col("hashes")),
        lambda p: F.struct(
            codec.hash_key(p["algo"]).alias("key"), entry(p["hash"], "string").alias("value")
        ),
    )
    updated = F.array(
        F.struct(
            F.lit(KEY_UPDATED_AT).alias("key"), entry(F.col("updated_at"), "int").alias("value")
        )
    )
    joined = state.select("file_id", "updated_at").join(wide_index(index), "file_id", "left")
    entries = F.concat(F.coalesce(hashes, F.slice(updated, 1, 0)), updated)
    return joined.select("file_id", F.to_json(F.map_from_entries(entries)).alias("json"))
