"""Rule lists and string lists kept as JSON settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.constants import MODE_AUTO, SCOPE_ALL
from fpindex.functions import codec

_RULE = (
    "array<struct<id:string,enabled:string,mode:string,algos:array<string>,"
    "path:string,userScope:string>>"
)


def read_rules(settings: DataFrame, json_col: str = "json") -> DataFrame:
    """Ordered JSON rule array as rule rows; malformed or non-array text gives none.

    Other columns of ``settings`` are kept, so a table of settings is read in
    one pass. The array position is the priority; absent fields get defaults.
    """
    others = [c for c in settings.columns if c != json_col]
    text = F.col(json_col)
    parsed = F.when(F.ltrim(text).startswith("["), F.from_json(text, _RULE))
    rule = F.col("col")
    path = F.coalesce(rule["path"], F.lit("**"))
    enabled = F.coalesce(rule["enabled"], F.lit(""))
    return (
        settings.select(*others, F.posexplode(parsed))
        .filter(rule.isNotNull())
        .select(
            *others,
            F.col("pos").cast("int").alias("priority"),
            rule["id"].alias("id"),
            (~F.lower(enabled).isin("", "0", "false")).alias("enabled"),
            F.coalesce(rule["mode"], F.lit(MODE_AUTO)).alias("mode"),
            rule["algos"].alias("algos"),
            F.when(path.isin("", "/"), F.lit("**")).otherwise(path).alias("path"),
            F.coalesce(rule["userScope"], F.lit(SCOPE_ALL)).alias("user_scope"),
        )
    )


def read_string_list(json: Column) -> Column:
    """JSON string array without its empty and non-string entries; ``[]`` if malformed."""
    entries = F.filter(
        F.from_json(json, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING"
    )
    texts = F.transform(entries, lambda v: F.variant_get(v, "$", "string"))
    return F.coalesce(F.filter(texts, lambda x: x != ""), F.array().cast("array<string>"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """Rules with unsupported algorithms dropped; ``valid`` is false if none is left."""
    kept = codec.supported_only(F.coalesce("algos", F.array(F.lit("sha1"))))
    return rules.withColumn("algos", kept).withColumn("valid", F.size("algos") > 0)
