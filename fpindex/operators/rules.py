"""Ordered glob rules: which rule owns a file, and what it marks."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, MODE_AUTO, SCOPE_ALL
from fpindex.functions.globs import glob_match
from fpindex.operators.joins import top_per_key
from fpindex.operators.many_rules import first_of_many
from fpindex.sources.inventory import only_files

# Rules per CASE expression; longer lists are evaluated as a chain of them.
_CHUNK = 64
# Rules that become branches of a plan; more of them are looked up in a table.
MOST_BRANCHES = 1000


@dataclass(frozen=True)
class Rule:
    """One rule of the ordered list."""

    id: str
    path: str = "**"
    user_scope: str = SCOPE_ALL
    mode: str = MODE_AUTO
    algos: tuple[str, ...] = ALGOS
    enabled: bool = True

    @property
    def glob(self) -> str:
        return "**" if self.path in ("", "/") else self.path


def collect_rules(rules: DataFrame) -> list[Rule]:
    """Rules of a rule table in priority order.

    A rule list is one hand-written setting; it becomes part of the plan, the
    way literals in a query do.
    """
    return [
        Rule(
            r["id"],
            r["path"] or "**",
            r["user_scope"] or SCOPE_ALL,
            r["mode"] or MODE_AUTO,
            tuple(r["algos"]) if r["algos"] is not None else ALGOS,
            bool(r["enabled"]),
        )
        for r in rules.orderBy("priority").toLocalIterator()
    ]


def applies(rule: Rule, path: Column, owner: Column | None) -> Column:
    """Whether a rule covers a path; an unknown owner is not held against it."""
    covers = glob_match(path, rule.glob)
    if owner is None or rule.user_scope == SCOPE_ALL:
        return covers
    return (owner.isNull() | (owner == rule.user_scope)) & covers


def first_rule(rules: Sequence[Rule], path: Column, owner: Column | None = None) -> Column:
    """Position in ``rules`` of the first enabled rule that applies, or null.

    One CASE expression per chunk of rules: evaluation stops at the first match,
    there is no join, and the number of rules is not limited.
    """
    enabled = [(i, r) for i, r in enumerate(rules) if r.enabled]
    chains = []
    for start in range(0, len(enabled), _CHUNK):
        chain = F
        for i, rule in enabled[start : start + _CHUNK]:
            chain = chain.when(applies(rule, path, owner), F.lit(i))
        chains.append(chain)
    return F.coalesce(*chains) if chains else F.lit(None).cast("int")


_FIELDS = "array<struct<id:string,mode:string,algos:array<string>>>"


def rule_at(rules: Sequence[Rule], position: Column) -> Column:
    """``struct<id,mode,algos>`` of the rule at a position; null for no rule.

    The rules are one literal, which the optimizer parses once.
    """
    text = json.dumps([{"id": r.id, "mode": r.mode, "algos": r.algos} for r in rules])
    # element_at alone is not null for a null position when no element is
    return F.when(
        position.isNotNull(), F.element_at(F.from_json(F.lit(text), _FIELDS), position + 1)
    )


def match_rules(
    files: DataFrame, rules: Sequence[Rule], path: str = "path", owner: str | None = "owner"
) -> DataFrame:
    """Add ``rule_priority``, ``rule_id``, ``rule_mode`` and ``rule_algos``."""
    if len(rules) > MOST_BRANCHES:
        placed = first_of_many(files, rules, path, owner)
    else:
        position = first_rule(rules, F.col(path), None if owner is None else F.col(owner))
        placed = files.withColumn("rule_priority", position)
    rule = F.col("_rule")
    return (
        placed.withColumn("_rule", rule_at(rules, F.col("rule_priority")))
        .select(
            *files.columns,
            "rule_priority",
            rule["id"].alias("rule_id"),
            rule["mode"].alias("rule_mode"),
            rule["algos"].alias("rule_algos"),
        )
    )


def fresh(updated_at: Column, mtime: Column) -> Column:
    """Hashed at or after the last change."""
    return F.coalesce(updated_at >= mtime, F.lit(False))


def stale_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """``(file_id, mtime, updated_at)`` of the files whose hashes are not fresh."""
    joined = only_files(files).select(F.col("fileid").alias("file_id"), "mtime").join(
        state.select("file_id", "updated_at"), "file_id", "left"
    )
    return joined.filter(~fresh(F.col("updated_at"), F.col("mtime")))


def evaluate_rules(files: DataFrame, rules: Sequence[Rule], state: DataFrame) -> DataFrame:
    """One row per file a rule owns: ``(file_id, rule_id, mode, stale)``.

    ``files`` has ``fileid, path, owner, mtime``. The first rule owns a file; the
    stale ones are to be marked with its mode.
    """
    listed = only_files(files).select("fileid", "path", "owner", "mtime")
    owned = match_rules(listed, rules).filter(
        F.col("rule_priority").isNotNull()
    )
    joined = owned.withColumnRenamed("fileid", "file_id").join(
        state.select("file_id", "updated_at"), "file_id", "left"
    )
    return joined.select(
        "file_id",
        "rule_id",
        F.col("rule_mode").alias("mode"),
        (~fresh(F.col("updated_at"), F.col("mtime"))).alias("stale"),
    )


def cap_marks(evaluated: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` stale files per rule, lowest ids first."""
    return top_per_key(
        evaluated.filter("stale"), ["rule_id"], [F.asc("file_id")], cap, spread_by="file_id"
    )


def rule_totals(evaluated: DataFrame) -> DataFrame:
    """Matched and marked files per rule."""
    return evaluated.groupBy("rule_id").agg(
        F.count("*").alias("matched"), F.count_if("stale").alias("marked")
    )


def process_rule(
    files: DataFrame, rules: Sequence[Rule], state: DataFrame, rule_id: str
) -> DataFrame:
    """Files of one rule, after the rules before it took theirs."""
    return evaluate_rules(files, rules, state).filter(F.col("rule_id") == rule_id)
