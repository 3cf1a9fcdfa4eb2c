"""Column expressions over paths and storage names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def owner_from_storage(storage_id: Column) -> Column:
    """``home::bob`` and ``local::/srv/bob`` belong to ``bob``; other names to themselves."""
    return (
        F.when(storage_id.startswith("home::"), F.substring(storage_id, 7, 1 << 20))
        .when(
            storage_id.startswith("local::"),
            F.substring_index(F.rtrim(storage_id, F.lit("/")), "/", -1),
        )
        .otherwise(storage_id)
    )


def display_path(path: Column, name: Column) -> Column:
    return F.when(F.coalesce(path, F.lit("")) == "", name).otherwise(path)


def relative_path(path: Column, base: Column) -> Column:
    """Path below ``base``; ``''`` for the base itself, no leading slash outside it."""
    root = F.rtrim(base, F.lit("/"))
    folder = F.concat(root, F.lit("/"))
    return (
        F.when(path == root, F.lit(""))
        .when(F.startswith(path, folder), F.substring(path, F.length(folder) + 1, F.length(path)))
        .otherwise(F.ltrim(path, F.lit("/")))
    )


def rule_folder(glob: Column) -> Column:
    """Literal folder in front of the first wildcard, with a leading slash."""
    text = F.trim(glob)
    literal = F.rtrim(F.regexp_extract(text, r"^[^*?\[{]*", 0), F.lit("/"))
    return (
        F.when(text.isin("", "/", "**") | (literal == ""), F.lit("/"))
        .when(literal.startswith("/"), literal)
        .otherwise(F.concat(F.lit("/"), literal))
    )
