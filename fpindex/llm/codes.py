"""Vector codes: each part of a vector is named by the nearest entry of a codebook.

Codebooks are trained in rounds, each of which assigns every part to its
nearest entry and moves the entries to the means of their parts. All numbers
are integers and all results exact.

Few distances are computed after the first round. The entries of a codebook
form groups of near entries. A part keeps, for each group, a lower bound of its
distance to the group's entries (other than its own entry) and the round in
which the bound was exact. As the codebooks of all rounds are kept, a bound of
round ``s`` holds in round ``t`` less the *net* displacement of the group's
entries between the two, ``max |c_t - c_s|``, which is at most, and mostly less
than, the sum of the displacements of the rounds between. Only groups whose
bound does not exceed the exact distance to the part's own entry are scanned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import HOT_GROUP_ROWS
from fpindex.llm.scratch import Scratch
from fpindex.operators.joins import join_groups

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 16, 64, 2, 8, 256
#: Components of vectors that are worked on at once.
BATCH_ELEMENTS = 1 << 20
#: Squared distances of whole vectors are below this.
LARGEST = 1 << 62
#: Bounds are lowered and displacements raised by this share, so that rounding never makes a bound too large.
SLACK = 1e-6


class State(NamedTuple):
    """What is known of the parts of some vectors: codes (n, parts), bounds and their rounds (n, parts, groups)."""

    codes: np.ndarray
    bounds: np.ndarray
    stamps: np.ndarray


def _kind(*arrays: np.ndarray):
    """The faster type in which squared distances of these vectors are exact."""
    top = max(int(np.abs(a).max(initial=0)) for a in arrays)
    return np.float64 if 4 * top * top * arrays[0].shape[1] < 1 << 52 else np.int64


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to all entries."""
    kind = _kind(x, entries)
    x, entries = x.astype(kind), entries.astype(kind)
    found = (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)
    return found.astype(np.int64)


def entry_groups(entries: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each entry: entries far from each other, and what is near each of them."""
    seeds = [0]
    while len(seeds) < min(groups, len(entries)):
        seeds.append(int(squares(entries, entries[seeds]).min(axis=1).argmax()))
    return squares(entries, entries[seeds]).argmin(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def _below(squared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Lower bounds of the least distances of each row, that to the own column left out."""
    left = np.where(own, np.inf, squared.astype(np.float64))
    return (np.sqrt(left.min(axis=1, initial=np.inf)) * (1 - SLACK)).astype(np.float32)


def assign_all(x: np.ndarray, codebooks: np.ndarray, groups: np.ndarray, stamp: int = 0) -> tuple[State, np.ndarray, int]:
    """Nearest entry of each part by all distances; ties go to the lower index.

    ``x`` has shape (n, parts, width), ``codebooks`` (parts, entries, width) and
    ``groups`` (parts, entries). Gives the state, squared distances (n, parts)
    and the number of distances computed.
    """
    n, parts = x.shape[:2]
    of_groups = int(groups.max(initial=0)) + 1
    codes = np.zeros((n, parts), np.uint8)
    bounds = np.full((n, parts, of_groups), np.inf, np.float32)
    nearest = np.zeros((n, parts), np.int64)
    for p in range(parts):
        d = squares(x[:, p], codebooks[p])
        best = d.argmin(axis=1)
        codes[:, p], nearest[:, p] = best, d[np.arange(n), best]
        for g in range(of_groups):
            members = np.flatnonzero(groups[p] == g)
            bounds[:, p, g] = _below(d[:, members], members == best[:, None])
    return State(codes, bounds, np.full(bounds.shape, stamp, np.uint8)), nearest, n * groups.size


def net_displacements(history: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each round before the last, part and group: how far an entry got from there to the last round, at most."""
    apart = history[:-1].astype(np.float64) - history[-1].astype(np.float64)
    far = np.sqrt((apart * apart).sum(axis=3)) * (1 + SLACK)
    found = np.zeros((*far.shape[:2], int(groups.max(initial=0)) + 1))
    for p in range(groups.shape[0]):
        for g in range(found.shape[2]):
            found[:, p, g] = far[:, p, groups[p] == g].max(axis=1, initial=0)
    return found


def assign_again(x: np.ndarray, history: np.ndarray, groups: np.ndarray, state: State) -> tuple[State, np.ndarray, int]:
    """As :func:`assign_all` for the last codebooks of ``history``, with the bounds of earlier rounds."""
    n, parts = x.shape[:2]
    now, computed = len(history) - 1, 0
    moved, codebooks = net_displacements(history, groups), history[-1]
    codes, bounds, stamps = (np.array(a) for a in state)
    nearest = np.zeros((n, parts), np.int64)
    for p in range(parts):
        before = codes[:, p].astype(np.int64)
        own = ((x[:, p] - codebooks[p][before]) ** 2).sum(axis=1)
        computed += n
        reach = _root(own) * (1 + SLACK)
        best, least = before.copy(), own.copy()
        scanned: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def scan(g: int, who: np.ndarray, members: np.ndarray) -> None:
            nonlocal computed
            d = squares(x[who, p], codebooks[p][members])
            computed += d.size
            scanned.append((who, members, d))
            first = d.argmin(axis=1)
            at, to = d[np.arange(len(who)), first], members[first]
            better = (at < least[who]) | ((at == least[who]) & (to < best[who]))
            best[who[better]], least[who[better]] = to[better], at[better]

        wide = bounds[:, p] - moved[stamps[:, p], p, np.arange(bounds.shape[2])] <= reach[:, None]
        at_group = {}
        for g in range(bounds.shape[2]):
            members, who = np.flatnonzero(groups[p] == g), np.flatnonzero(wide[:, g])
            if len(who) and len(members):
                at_group[len(scanned)] = g
                scan(g, who, members)
        # the entry left behind is from now on among those that its group's bound is about
        changed = best != before
        for g in range(bounds.shape[2]):
            who = np.flatnonzero(changed & (groups[p][before] == g) & ~wide[:, g])
            if len(who):
                at_group[len(scanned)] = g
                scan(g, who, np.flatnonzero(groups[p] == g))
        for i, (who, members, d) in enumerate(scanned):
            bounds[who, p, at_group[i]] = _below(d, members == best[who, None])
            stamps[who, p, at_group[i]] = now
        codes[:, p], nearest[:, p] = best, least
    return State(codes, bounds, stamps), nearest, computed


def part_sums(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, width) and numbers (parts, entries) of the parts of each entry."""
    parts, width = x.shape[1:]
    sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(sums[p], codes[:, p], x[:, p])
        counts[p] = np.bincount(codes[:, p], minlength=entries)
    return sums, counts


_ROW = "v array<long>, codes binary, bounds binary, stamps binary, error long, computed long"


def _vectors(column: pa.Array, parts: int) -> np.ndarray:
    """Stored vectors of one width as an array (n, parts, width)."""
    flat = np.asarray(column.flatten(), np.int64)
    return flat.reshape(len(column), parts, -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            step = max(1, BATCH_ELEMENTS // max(1, len(batch.column("v")[0])))
            yield from (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def _usable(parts: int, scale: int):
    """Rows with a whole vector of finite components, as scaled integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.asarray(vectors.value_lengths().fill_null(0), np.int64)
            values = np.asarray(vectors.flatten().cast(pa.float64()).fill_null(np.nan))
            ends = np.cumsum(sizes)
            wrong = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
            scaled = np.floor(scale * values[np.repeat(good, sizes)])
            top = float(np.abs(scaled).max(initial=0))
            if 4 * top * top * int(sizes.max(initial=0)) >= LARGEST:
                raise ValueError("squared distances of the scaled vectors would not fit into 63 bits")
            kept = batch.filter(pa.array(good))
            offsets = np.concatenate([[0], np.cumsum(sizes[good])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [kept.column("vec_id"), kept.column("label"),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(scaled.astype(np.int64)))],
                names=["vec_id", "label", "v"],
            )

    return run


def _assigning(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        history, groups = model.value
        parts, of_groups = groups.shape[0], int(groups.max(initial=0)) + 1
        for batch in _slices(batches):
            x = _vectors(batch.column("v"), parts)
            n = len(x)
            if "codes" in batch.schema.names:

                def stored(name: str, kind, *shape: int) -> np.ndarray:
                    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, *shape)

                state = State(
                    stored("codes", np.uint8, parts),
                    stored("bounds", np.float32, parts, of_groups),
                    stored("stamps", np.uint8, parts, of_groups),
                )
                state, nearest, computed = assign_again(x, history, groups, state)
            else:
                state, nearest, computed = assign_all(x, history[-1], groups, len(history) - 1)
            shares = np.full(n, computed // n)
            shares[: computed % n] += 1
            if "computed" in batch.schema.names:
                shares += np.asarray(batch.column("computed"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    batch.column("v"),
                    *[pa.array([row.tobytes() for row in a], pa.binary()) for a in state],
                    pa.array(nearest.sum(axis=1)),
                    pa.array(shares, pa.int64()),
                ],
                names=["vec_id", "label", "v", "codes", "bounds", "stamps", "error", "computed"],
            )

    return run


def _summing(parts: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = None, None
        for batch in _slices(batches):
            x = _vectors(batch.column("v"), parts)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(len(x), parts)
            s, c = part_sums(x, codes, entries)
            sums, counts = (s, c) if sums is None else (sums + s, counts + c)
        if sums is not None:
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(p, pa.int32()),
                    pa.array(e, pa.int32()),
                    pa.array(counts[p, e], pa.int64()),
                    pa.array(sums[p, e].tolist(), pa.list_(pa.int64())),
                ],
                names=["part", "entry", "n", "sums"],
            )

    return run


def moved_codebooks(assigned: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks whose entries are the floored means of their parts; entries without parts stay.

    Tasks add up their rows; one row per entry reaches the driver.
    """
    parts, entries, width = codebooks.shape
    rows = assigned.select("v", "codes").mapInArrow(
        _summing(parts, entries), "part int, entry int, n long, sums array<long>"
    )
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    found = codebooks.copy()
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        found[r.part, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return found


def codebooks_digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for x in codebooks.ravel()).encode()).hexdigest()


def vector_codes(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    groups: int = GROUPS,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256, computed`` of every usable vector.

    Components ``x`` become ``floor(scale * x)``. Codebooks start as the parts of
    the ``entries`` smallest ids and are moved ``rounds`` times. ``code`` has two
    hexadecimal digits per part; ``error`` is the sum of the squared distances,
    ``label_error`` that sum over all rows of one label, null being a label of
    its own. ``computed`` is the row's share of the distances that its batches computed.

    Vectors that are null or empty or hold null or non-finite components are
    left out, and an empty table gives an empty result. With fewer usable rows
    than ``entries`` the codebooks are smaller. Rows of equal ids are ordered by
    their vectors, null ids come last, and repeated rows are rows of their own.
    All usable vectors have one length that ``parts`` divides, and squared
    distances fit into 63 bits; other tables are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have two hexadecimal digits: 1 to 256 entries")
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id, label)}
    names = f"vec_id {kinds[id]}, label {kinds[label]}, "
    rows = scratch.store(
        vectors.select(F.col(id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).mapInArrow(
            _usable(parts, scale), names + "v array<long>"
        )
    )
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    result = names + "code string, error long"
    if not first:
        coded = spark.createDataFrame([], result + ", computed long")
        history = np.zeros((1, parts, 0, 0), np.int64)
    else:
        lengths = rows.agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
        if lengths.low != lengths.high or lengths.low % parts:
            raise ValueError(f"vectors of {lengths.low} to {lengths.high} components in {parts} equal parts")
        start = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1)
        grouped = np.stack([entry_groups(start[p], groups) for p in range(parts)])
        history, state = start[None], rows
        for turn in range(rounds + 1):
            model = spark.sparkContext.broadcast((history, grouped))
            state = scratch.store(state.mapInArrow(_assigning(model), names + _ROW))
            if turn < rounds:
                history = np.concatenate([history, moved_codebooks(state, history[-1])[None]])
        coded = state.select(
            "vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error", "computed"
        )
    keyed = coded.select(
        "*", F.coalesce(F.col("label").cast("string"), F.lit("")).alias("key"), F.col("label").isNull().alias("no_label")
    )
    totals = keyed.groupBy("key", "no_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    done = join_groups(keyed, totals, ["key", "no_label"], "n", "vec_id", hot_rows)
    digest = codebooks_digest(history[-1])
    if first:
        scratch.drop(state)
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "computed")
