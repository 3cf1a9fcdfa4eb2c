"""The column functions under SQL names."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, PACKED_MAX_BYTES
from fpindex.functions.digests import NATIVE_ALGOS, hex_digests
from fpindex.functions.globs import REGEX_END, glob_to_regex
from fpindex.functions.terms import TERM


def _match_all(paths: pa.Array, glob: str) -> np.ndarray:
    """Whether each path, none of which is null, matches one glob; all at once by RE2 where it knows the pattern."""
    pattern = glob_to_regex(glob)
    try:
        return np.asarray(pc.match_substring_regex(paths, pattern.removesuffix(REGEX_END) + r"\z"))
    except pa.ArrowInvalid:
        compiled = re.compile(pattern)
        return np.array([compiled.search(p) is not None for p in paths.to_pylist()], bool)


def match_globs(paths: pa.Array, globs: pa.Array) -> pa.Array:
    """Whether each path matches its glob; null where either is null. Paths are matched together per glob."""
    known = pc.and_(paths.is_valid(), globs.is_valid())
    rows = np.flatnonzero(np.asarray(known))
    coded = globs.take(pa.array(rows)).dictionary_encode()
    order = np.argsort(np.asarray(coded.indices), kind="stable")
    edges = np.searchsorted(np.asarray(coded.indices)[order], np.arange(len(coded.dictionary) + 1))
    found = np.zeros(len(paths), bool)
    for glob, a, b in zip(coded.dictionary.to_pylist(), edges, edges[1:]):
        mine = rows[order[a:b]]
        found[mine] = _match_all(paths.take(pa.array(mine)), glob)
    return pa.array(found, mask=~np.asarray(known))


def register_functions(spark: SparkSession) -> None:
    """Register the SQL functions of this library in the session.

    The codecs are SQL functions that Catalyst inlines. A glob that is itself
    a column and the digests Spark lacks run as Arrow functions.
    """

    @F.arrow_udf("boolean")
    def glob_match(paths: pa.Array, globs: pa.Array) -> pa.Array:
        return match_globs(paths, globs)

    @F.arrow_udf("string")
    def arrow_digest(content: pa.Array, algos: pa.Array) -> pa.Array:
        return pa.array(
            [
                hex_digests((c.as_buffer(),), [a])[0] if c.is_valid and a in ALGOS else None
                for c, a in zip(content, algos.to_pylist())
            ],
            pa.string(),
        )

    spark.udf.register("glob_match", glob_match)
    spark.udf.register("arrow_digest", arrow_digest)

    native = {"sha1": "sha1(content)", "md5": "md5(content)"}
    native |= {a: f"sha2(content, {a[3:]})" for a in NATIVE_ALGOS if a not in native}
    branches = " ".join(f"WHEN '{a}' THEN {sql}" for a, sql in native.items())
    others = ", ".join(f"'{a}'" for a in ALGOS if a not in NATIVE_ALGOS)
    pattern = TERM.replace("\\", "\\\\")
    definitions = {
        "content_digest(content BINARY, algo STRING) RETURNS STRING": f"""
            CASE lower(algo) {branches} ELSE arrow_digest(
                CASE WHEN lower(algo) IN ({others}) THEN content END, lower(algo)) END""",
        "parse_checksums(packed STRING) RETURNS MAP<STRING, STRING>": """
            aggregate(
                filter(split(coalesce(packed, ''), ' '), p -> p RLIKE '^[^:]+:[^:]+$'),
                CAST(map() AS MAP<STRING, STRING>),
                (acc, p) -> map_concat(
                    map_filter(acc, (k, v) -> k <> lower(substring_index(p, ':', 1))),
                    map(lower(substring_index(p, ':', 1)), substring_index(p, ':', -1))))""",
        "pack_checksums(hashes MAP<STRING, STRING>) RETURNS STRING": f"""
            aggregate(
                filter(
                    transform(
                        array({", ".join(f"'{a}'" for a in ALGOS)}),
                        a -> concat(upper(a), ':', try_element_at(hashes, a))),
                    p -> p IS NOT NULL),
                '',
                (acc, p) -> CASE
                    WHEN acc = '' THEN CASE WHEN octet_length(p) > {PACKED_MAX_BYTES} THEN acc ELSE p END
                    WHEN octet_length(acc) + 1 + octet_length(p) > {PACKED_MAX_BYTES} THEN acc
                    ELSE concat(acc, ' ', p) END)""",
        "parse_hash_term(term STRING) RETURNS STRUCT<algo: STRING, hash: STRING>": f"""
            CASE WHEN term RLIKE '{pattern}' THEN named_struct(
                'algo', nullif(lower(regexp_extract(term, '{pattern}', 1)), ''),
                'hash', lower(regexp_extract(term, '{pattern}', 2))) END""",
    }
    for signature, body in definitions.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
