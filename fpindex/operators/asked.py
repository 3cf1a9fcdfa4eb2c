"""Which rows of a large table a plan asks for, decided where the rows are read.

A plan names files and the algorithms each of them needs. Its ids are hashed
into bit fields of bounded size, one per algorithm, which are broadcast to
where the table is read. A row whose id is in none of them is dropped right
behind the scan; any other one has the algorithms in whose fields it is. There
is no false negative, and with ``BITS_PER_ID`` about one false positive in
5,000, which the exact join with the plan removes later. So there is one way
for plans of all sizes, contents are never shuffled, and little but the asked
algorithms of the asked files is computed. A plan too large for ``MOST_BITS``
makes the fields denser: more is computed than asked for, and the result stays
the same.

The least and the greatest id are compared too; that comparison reaches the
statistics of the files.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of one value of Spark's bitmap functions.
_BITMAP = 32768
LEAST_BITS, BITS_PER_ID, MOST_BITS = 1 << 20, 32, 1 << 29
MOST_HASHES = 4


def _place(key: str, parts: int) -> str:
    """Part of a field that an id belongs to."""
    return f"pmod(xxhash64({key}) & {(1 << 34) - 1}L, {parts})"


def _bits(key: str, hashes: int) -> list[str]:
    """Bits of an id in its part; the part and they come from one hash."""
    first, step = f"shiftrightunsigned(xxhash64({key}), 49)", f"(shiftrightunsigned(xxhash64({key}), 34) & 32767L | 1L)"
    return [f"CAST({first} + {j} * {step} & {_BITMAP - 1}L AS INT)" for j in range(hashes)]


def _is_set(bitmap: str, bit: str) -> str:
    byte = f"CAST(conv(hex(substring({bitmap}, shiftright({bit}, 3) + 1, 1)), 16, 10) AS INT)"
    return f"bit_get({byte}, {bit} & 7) = 1"


@dataclass(frozen=True)
class IdFilter:
    """Bit fields over the ids of a plan, one for each of ``names``; see :func:`id_filter`."""

    field: DataFrame
    names: tuple[str, ...]
    parts: int
    hashes: int
    entries: int
    low: int | None
    high: int | None

    def _in_range(self, df: DataFrame, key: str) -> DataFrame:
        return df.filter(F.lit(False) if self.low is None else F.col(key).between(self.low, self.high))

    def _found(self, key: str) -> list[str]:
        """For each name, whether its field has the id."""
        bits = _bits(_quoted(key), self.hashes)
        return [" AND ".join(_is_set(f"_map{i}", b) for b in bits) for i in range(len(self.names))]

    def _same_part(self, key: str) -> Column:
        return F.expr(f"{_place(_quoted(key), self.parts)} = _part")

    def keep(self, df: DataFrame, key: str = "file_id") -> DataFrame:
        """Rows of a table whose id is probably in the plan; join them exactly later."""
        any_ = F.expr(" OR ".join(f"({t})" for t in self._found(key)))
        return self._in_range(df, key).join(F.broadcast(self.field), self._same_part(key) & any_, "left_semi")

    def asked(self, df: DataFrame, key: str = "file_id", out: str = "needed") -> DataFrame:
        """As :meth:`keep`, with the names in whose fields an id is as array ``out``."""
        named = ", ".join(f"CASE WHEN {t} THEN '{n}' END" for t, n in zip(self._found(key), self.names))
        joined = self._in_range(df, key).join(F.broadcast(self.field), self._same_part(key))
        needed = F.expr(f"array_compact(array({named}))")
        return joined.select(*df.columns, needed.alias(out)).filter(F.size(out) > 0)


#: Tables are reduced for plans of less than this share of the files; others would keep most rows anyway.
WORTHWHILE = 0.25


def reduce_tables(wanted: IdFilter, files: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """Inventory and other tables without most of the files that a small plan leaves out.

    It changes nothing but the work of the exact joins that follow.
    """
    if wanted.entries > WORTHWHILE * files.select("fileid").count():
        return [files, *others]
    return [wanted.keep(files, "fileid"), *[wanted.keep(t) for t in others]]


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def id_filter(
    ids: DataFrame,
    names: Sequence[str] = ("",),
    needed: str | None = None,
    key: str = "file_id",
    within: IdFilter | None = None,
) -> IdFilter:
    """Filter for the ids of ``ids``; with the array column ``needed`` one field per name.

    ``ids`` is read twice: cut its lineage first. Only its number of rows and
    the bounds of its ids reach the driver. With ``within``, a filter that
    covers all the ids, that filter's numbers are taken instead.
    """
    entries = ids.filter(F.col(key).isNotNull())
    if needed is not None:
        entries = entries.filter(F.size(needed) > 0)
    if within is None:
        size = entries.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
        n, low, high = size.n, size.low, size.high
    else:
        n, low, high = within.entries, within.low, within.high
    bits = LEAST_BITS
    while bits < BITS_PER_ID * n and 2 * bits * len(names) <= MOST_BITS:
        bits *= 2
    parts, hashes = bits // _BITMAP, max(1, min(MOST_HASHES, round(0.7 * bits / max(1, n))))
    in_field = [F.lit(True) if needed is None else F.array_contains(needed, n) for n in names]
    listed = entries.select(
        F.expr(_place(_quoted(key), parts)).alias("_part"),
        F.expr(f"explode(array({', '.join(_bits(_quoted(key), hashes))}))").alias("_bit"),
        *[f.alias(f"_{i}") for i, f in enumerate(in_field)],
    )
    field = listed.groupBy("_part").agg(
        *[F.expr(f"bitmap_construct_agg(CASE WHEN _{i} THEN _bit END)").alias(f"_map{i}") for i in range(len(names))]
    )
    return IdFilter(field, tuple(names), parts, hashes, n, low, high)
