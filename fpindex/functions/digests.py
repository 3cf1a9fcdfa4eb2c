"""Content digests.

Four algorithms are Spark built-ins and run inside generated code. The other
four have no built-in; one Arrow function computes all of them that a query
asks for, so a content value crosses to Python at most once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.functions.codec import names

NATIVE_ALGOS = ("sha1", "md5", "sha256", "sha512")
PYTHON_ALGOS = tuple(a for a in ALGOS if a not in NATIVE_ALGOS)

_BIT_REVERSED = bytes(int(f"{value:08b}"[::-1], 2) for value in range(256))


def reversed_bits(data) -> bytes:
    """The bytes with the bits of each reversed."""
    return bytes(data).translate(_BIT_REVERSED)


def crc32_hex(value: int) -> str:
    """Text of a CRC-32 of reversed bytes: bits reversed again, low byte first."""
    return int(f"{value:032b}"[::-1], 2).to_bytes(4, "little").hex()


class _Adler32:
    def __init__(self) -> None:
        self._value = 1

    def update(self, data) -> None:
        self._value = zlib.adler32(data, self._value)

    def hexdigest(self) -> str:
        return f"{self._value:08x}"


class _Crc32:
    """CRC-32 with unreflected input and output, low byte first.

    This is not the zlib checksum: reversing the bits of every input byte and
    of the result turns one into the other.
    """

    def __init__(self) -> None:
        self._value = 0

    def update(self, data) -> None:
        self._value = zlib.crc32(reversed_bits(data), self._value)

    def hexdigest(self) -> str:
        return crc32_hex(self._value)


def new_digest(algo: str):
    """Incremental digest with ``update`` and ``hexdigest``."""
    if algo == "adler32":
        return _Adler32()
    if algo == "crc32":
        return _Crc32()
    return hashlib.new(algo.replace("-", "_"), usedforsecurity=False)


def hex_digests(chunks: Iterable, algos: Sequence[str]) -> list[str]:
    """Digests of the concatenated chunks, every chunk read once."""
    digests = [new_digest(algo) for algo in algos]
    for chunk in chunks:
        for digest in digests:
            digest.update(chunk)
    return [digest.hexdigest() for digest in digests]


def _field(algo: str) -> str:
    return algo.replace("-", "_")


def _arrow_digests(algos: Sequence[str]):
    names = [_field(a) for a in algos]

    @F.arrow_udf("struct<" + ",".join(f"{n}:string" for n in names) + ">")
    def digests(content: pa.Array) -> pa.Array:
        rows = [
            hex_digests((value.as_buffer(),), algos) if value.is_valid else [None] * len(algos)
            for value in content
        ]
        columns = zip(*rows) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    return digests


def _native(content: Column, algo: str) -> Column:
    if algo == "sha1":
        return F.sha1(content)
    if algo == "md5":
        return F.md5(content)
    return F.sha2(content, int(algo[3:]))


def checked_algos(algos: Sequence[str]) -> list[str]:
    """Lower-cased distinct list; unknown names are refused."""
    listed = list(dict.fromkeys(a.lower() for a in algos))
    unknown = [a for a in listed if a not in ALGOS]
    if unknown:
        raise ValueError(f"unsupported algorithms: {unknown}")
    return listed


def with_digests(
    df: DataFrame,
    content: str,
    algos: Sequence[str] = ALGOS,
    needed: str | None = None,
    out: str = "digests",
) -> DataFrame:
    """Add ``out``: a ``map<algo,hash>`` of the digests of column ``content``.

    With ``needed`` (an array column of algorithm names) a row's digest is
    computed only if listed there. Rows with null content get null digests.
    The content column itself is dropped, so nothing above carries it.
    """
    algos = checked_algos(algos)
    if not algos:
        return df.drop(content).withColumn(out, F.create_map().cast("map<string,string>"))
    in_python = [a for a in algos if a in PYTHON_ALGOS]
    body = F.col(content)

    def asked(algo: str, value: Column) -> Column:
        return value if needed is None else F.when(F.array_contains(needed, algo), value)

    columns = {a: asked(a, _native(body, a)) for a in algos if a in NATIVE_ALGOS}
    if in_python:
        sent = body.cast("binary")
        if needed is not None:
            sent = F.when(F.arrays_overlap(F.col(needed), names(in_python)), sent)
        df = df.withColumn("_arrow", _arrow_digests(in_python)(sent))
        columns |= {a: asked(a, F.col("_arrow")[_field(a)]) for a in in_python}
    kept = [c for c in df.columns if c not in (content, "_arrow")]
    digests = F.map_from_arrays(names(algos), F.array(*[columns[a] for a in algos]))
    return df.select(*kept, digests.alias(out))


def digests_long(
    df: DataFrame, key: str, content: str, algos: Sequence[str] = ALGOS
) -> DataFrame:
    """Index rows ``(file_id, algo, hash)`` of a content table."""
    wide = with_digests(df.select(F.col(key).alias("file_id"), content), content, algos)
    # the outer form keeps Catalyst from inferring a size() filter below the
    # generator, which would compute every digest a second time
    return wide.select("file_id", F.explode_outer("digests").alias("algo", "hash")).filter(
        F.col("hash").isNotNull()
    )
