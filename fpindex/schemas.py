"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


FILES = _struct(
    ("fileid", T.LongType()),
    ("storage", T.LongType()),
    ("path", T.StringType()),
    ("name", T.StringType()),
    ("size", T.LongType()),
    ("mtime", T.LongType()),
    ("checksum", T.StringType()),
)

STORAGES = _struct(("numeric_id", T.LongType()), ("id", T.StringType()))

HASH_INDEX = _struct(("file_id", T.LongType()), ("algo", T.StringType()), ("hash", T.StringType()))

HASH_STATE = _struct(
    ("file_id", T.LongType()),
    ("updated_at", T.LongType()),
    ("pending_mode", T.StringType()),
)

RULES = _struct(
    ("priority", T.IntegerType()),
    ("id", T.StringType()),
    ("enabled", T.BooleanType()),
    ("mode", T.StringType()),
    ("algos", T.ArrayType(T.StringType())),
    ("path", T.StringType()),
    ("user_scope", T.StringType()),
)

FILE_EVENTS = _struct(
    ("event_id", T.LongType()),
    ("ts", T.TimestampType()),
    ("kind", T.StringType()),
    ("file_id", T.LongType()),
    ("source_file_id", T.LongType()),
    ("path", T.StringType()),
    ("owner", T.StringType()),
)

EAV_INDEX = _struct(
    ("file_id", T.LongType()),
    ("meta_key", T.StringType()),
    ("meta_value_string", T.StringType()),
    ("meta_value_int", T.LongType()),
)
