"""Places in a total order, without a task that sees all rows.

Rows are dealt by ranges of the order and sorted within their range. The number
of rows of each range tells where the range starts, so a row's place is that
start plus its place in the range. Only one number per range reaches the
driver. A slice of any size and depth reads the ranges it covers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.session import cut_lineage

_AT, _RANGE_BITS = "_at", 33


@dataclass(frozen=True)
class Ranked:
    """Rows in order, stored once; ``starts[i]`` is the place of the first row of range ``i``."""

    rows: DataFrame
    starts: Sequence[int]
    total: int

    def slice(self, limit: int | None = None, offset: int = 0, rank: str | None = None) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order, with their place from 0 on as ``rank`` if that is named."""
        end = self.total if limit is None else min(self.total, offset + limit)
        ends = [*self.starts[1:], self.total]
        hit = [i for i, (a, b) in enumerate(zip(self.starts, ends)) if a < end and b > offset]
        names = [c for c in self.rows.columns if c != _AT]
        if not hit:
            none = self.rows.filter("false")
            return none.select(*names, *([F.lit(0).cast("long").alias(rank)] if rank else []))
        part, at = F.shiftright(_AT, _RANGE_BITS), F.col(_AT).bitwiseAND(F.lit((1 << _RANGE_BITS) - 1))
        starts = F.split(F.lit(",".join(map(str, self.starts))), ",").cast("array<bigint>")
        place = F.get(starts, part.cast("int")) + at
        # ranges are compared first: those that the slice does not meet are dropped without any arithmetic
        found = self.rows.filter(part.between(hit[0], hit[-1]) & (place >= offset) & (place < end))
        return found.select(*names, *([place.alias(rank)] if rank else []))


def ranked(df: DataFrame, order: Sequence[Column]) -> Ranked:
    """All rows of ``df`` in an order that leaves no ties; ``df`` is computed once and stored."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = cut_lineage(dealt.withColumn(_AT, F.monotonically_increasing_id()))
    counts = stored.groupBy(F.shiftright(_AT, _RANGE_BITS).cast("int").alias("part")).count().collect()
    of_part = {r["part"]: r["count"] for r in counts}
    starts, total = [], 0
    for part in range(max(of_part, default=-1) + 1):
        starts.append(total)
        total += of_part.get(part, 0)
    return Ranked(stored, starts, total)


def first_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in order, for any ``n``."""
    return ranked(df, order).slice(n)
