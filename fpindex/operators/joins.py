"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fpindex.constants import HOT_GROUP_ROWS, SPREAD

_SALT = "_salt"


def _bucket(spread_by: str | Column, n: int | Column) -> Column:
    return F.pmod(F.xxhash64(spread_by), n if isinstance(n, Column) else F.lit(n)).cast("int")


def spread_join(
    big: DataFrame,
    small: DataFrame,
    on: str | Sequence[str],
    spread_by: str,
    how: str = "inner",
    copies: int | None = None,
) -> DataFrame:
    """Join a possibly skewed side with a much smaller one that is unique on ``on``.

    Rows of a hot key are dealt over ``copies`` tasks by ``spread_by``, by default
    an eighth of the shuffle partitions; the small side is repeated that often. If Catalyst sees that the small side fits its
    broadcast limit it still broadcasts it; nothing is forced. ``how`` may be
    inner, left, left_semi or left_anti.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if copies is None:
        copies = max(SPREAD, int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    left = big.withColumn(_SALT, _bucket(spread_by, copies))
    right = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def hot_join(
    big: DataFrame,
    other: DataFrame,
    on: str | Sequence[str],
    spread_by: str,
    how: str = "inner",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Join a possibly skewed side with a side of any size that is unique on ``on``.

    The keys with more than ``hot_rows`` rows are counted first and only those
    are repeated on the other side. There are at most ``big / hot_rows`` of them,
    which bounds the broadcast list.
    """
    keys = [on] if isinstance(on, str) else list(on)
    parts = F.ceil(F.col("_n") / hot_rows).cast("int")
    hot = (
        big.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys, parts.alias("_parts"))
    )
    share = F.coalesce("_parts", F.lit(1))
    left = big.join(F.broadcast(hot), keys, "left").withColumn(_SALT, _bucket(spread_by, share))
    right = other.join(F.broadcast(hot), keys, "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), share - 1))
    )
    return left.drop("_parts").join(right.drop("_parts"), [*keys, _SALT], how).drop(_SALT)


def join_groups(
    members: DataFrame,
    groups: DataFrame,
    on: Sequence[str],
    count: str,
    spread_by: str,
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Inner join of members with their groups, hot groups split by known size.

    ``groups`` is unique on ``on`` and ``count`` is the number of members of a
    group. A group above ``hot_rows`` members is cut into parts of about that
    size. No more than ``members / hot_rows`` groups can be that large, which
    bounds the broadcast list of them.
    """
    keys = list(on)
    parts = F.ceil(F.col(count) / hot_rows).cast("int")
    hot = groups.filter(F.col(count) > hot_rows).select(*keys, parts.alias("_parts"))
    left = members.join(F.broadcast(hot), keys, "left").withColumn(
        _SALT, F.when(F.col("_parts").isNull(), 0).otherwise(_bucket(spread_by, F.col("_parts")))
    )
    right = groups.withColumn(
        _SALT,
        F.explode(
            F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), parts - 1)).otherwise(
                F.array(F.lit(0))
            )
        ),
    )
    return left.drop("_parts").join(right, [*keys, _SALT], "inner").drop(_SALT)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int, spread_by: str
) -> DataFrame:
    """First ``cap`` rows of each key in two steps, so no task sees a whole hot key."""
    rank = F.row_number()
    local = Window.partitionBy(*keys, _SALT).orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    first = (
        df.withColumn(_SALT, _bucket(spread_by, 64))
        .withColumn("_rank", rank.over(local))
        .filter(F.col("_rank") <= cap)
        .drop("_rank", _SALT)
    )
    return first.withColumn("_rank", rank.over(final)).filter(F.col("_rank") <= cap).drop("_rank")
