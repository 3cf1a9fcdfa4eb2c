"""First matching rule out of many: rules as a table that paths are looked up in.

The literal head of a glob (what every match starts with), or else its literal
tail, is cut to a power of two of characters. Rules with the same cut text are
one row, and a path finds that row by its own first or last characters: one
lookup per length in use, at most ``2 * len(LENGTHS)`` whatever the number of
rules is. The rules of the few rows found are tried in order, with plain text
comparisons where they suffice. Globs without head and tail form one more row.
Nothing is shuffled, no path becomes more than one row, and the plan does not
grow with the rules.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.constants import SCOPE_ALL
from fpindex.functions.globs import glob_parts, glob_to_regex

LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128)

_CANDIDATE = "array<struct<priority:int,head:string,tail:string,least:int,inner:string,regex:string,scope:string>>"


def _place(head: str, tail: str) -> tuple[str, int, str]:
    """Side, length and text by which paths look a glob up."""
    text, side = (head, "head") if len(head) >= len(tail) else (tail, "tail")
    if not text:
        return "any", 0, ""
    n = max(length for length in LENGTHS if length <= len(text))
    return side, n, text[:n] if side == "head" else text[len(text) - n :]


def rule_table(spark: SparkSession, rules: Sequence) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``(side, n, text, candidates)`` of all enabled rules, and the sides and lengths in use."""
    rows = defaultdict(list)
    for i, rule in enumerate(rules):
        if not rule.enabled:
            continue
        parts = glob_parts(rule.glob)
        scope = None if rule.user_scope == SCOPE_ALL else rule.user_scope
        regex = None if parts.plain else glob_to_regex(rule.glob)
        rows[_place(parts.head, parts.tail)].append((i, parts.head, parts.tail, parts.least, parts.inner, regex, scope))
    table = spark.createDataFrame(
        [(side, n, text, found) for (side, n, text), found in rows.items()],
        f"side string, n int, text string, candidates {_CANDIDATE}",
    )
    return table, sorted({(side, n) for side, n, _ in rows})


def _fits(rule: Column, path: Column, owner: Column | None) -> Column:
    fits = (
        path.startswith(rule["head"])
        & path.endswith(rule["tail"])
        & (F.length(path) >= rule["least"])
        & (rule["inner"].isNull() | path.contains(rule["inner"]))
        & (rule["regex"].isNull() | F.regexp_like(path, rule["regex"]))
    )
    if owner is None:
        return fits
    return fits & (rule["scope"].isNull() | owner.isNull() | (owner == rule["scope"]))


def first_of_many(
    files: DataFrame, rules: Sequence, path: str = "path", owner: str | None = "owner", out: str = "rule_priority"
) -> DataFrame:
    """Add ``out``: the position in ``rules`` of the first enabled rule that applies, or null."""
    if not any(r.enabled for r in rules):
        return files.withColumn(out, F.lit(None).cast("int"))
    table, places = rule_table(files.sparkSession, rules)
    rows, found = files, []
    for k, (side, n) in enumerate(places):
        key = {"head": F.substring(path, 1, n), "tail": F.substring(path, -n, n), "any": F.lit("")}[side]
        # a path that is shorter than n has a shorter key, which no row of this length has
        part = table.filter((F.col("side") == side) & (F.col("n") == n)).select(
            F.col("text").alias(f"_text{k}"), F.col("candidates").alias(f"_rules{k}")
        )
        rows = rows.withColumn(f"_key{k}", key).join(F.broadcast(part), F.col(f"_key{k}") == F.col(f"_text{k}"), "left")
        fitting = F.filter(f"_rules{k}", lambda r: _fits(r, F.col(path), None if owner is None else F.col(owner)))
        rows = rows.withColumn(f"_first{k}", F.get(fitting, F.lit(0))["priority"])
        rows = rows.select(*files.columns, *[f"_first{j}" for j in range(k + 1)])
        found.append(F.col(f"_first{k}"))
    first = F.least(*found) if len(found) > 1 else found[0]
    return rows.select(*files.columns, first.alias(out))
