"""Near duplicates by SuperMinHash signatures, exact checks and union-find.

Texts become sets of word shingles. Texts with equal sets form a class at
once. Classes that share a band of their signatures are compared on their full
sets, and linked if the Jaccard similarity reaches the threshold. Linked
classes form a component, represented by its smallest document id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.llm.graph import components
from fpindex.llm.scratch import Scratch
from fpindex.llm.texts import BATCH_BYTES, mixed, segment_ids, small_batches, word_hashes
from fpindex.llm.workers import trim, whole_groups

#: 32 bands of 4 values: a pair at similarity 0.8 shares none of them once in 2 * 10^7.
BANDS, BAND_ROWS = 32, 4
#: Rows, and shingles in all, of a bucket that form a tile of the second round.
TILE, TILE_SHINGLES = 1024, 1 << 20
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the bounds of each text in them.

    A text of fewer words is one shingle; a text without words has none.
    """
    hashes, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][doc]
    length = np.minimum(counts, words)[doc]
    value = mixed(length.astype(np.uint64) + np.uint64(words))
    padded = np.append(hashes, np.zeros(words, np.uint64))
    for i in range(words):
        step = mixed(value * np.uint64(0xFF51AFD7ED558CCD) + padded[first + i])
        value = np.where(i < length, step, value)
    edges = np.concatenate([[0], np.cumsum(n)])
    for a, b in zip(edges[:-1], edges[1:]):
        value[a:b].sort()
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return value[fresh], np.searchsorted(doc[fresh], np.arange(len(n) + 1))


def super_minhash(sets: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``size`` unsigned integers per set.

    In step j every element draws the next position of its own random
    permutation (Fisher-Yates) and a random value; the value of step j is
    below all values of step j + 1. A set is done when all its positions
    hold values of steps gone by: later ones cannot lower them.
    """
    n_sets = len(bounds) - 1
    signature = np.full(n_sets * size, np.iinfo(np.uint64).max, np.uint64)
    owner = segment_ids(bounds)
    seed = sets.copy()
    state = np.tile(np.arange(size, dtype=np.uint16), (len(seed), 1))
    for j in range(size):
        if not len(seed):
            break
        draw = mixed(seed + np.uint64((j + 1) * _GOLDEN % 2**64))
        at = j + ((draw & np.uint64(0xFFFFFFFF)) % np.uint64(size - j)).astype(np.int64)
        rows = np.arange(len(seed))
        place = state[rows, at]
        state[rows, at] = state[:, j]
        value = (np.uint64(j) << np.uint64(54)) | (draw >> np.uint64(10))
        np.minimum.at(signature, owner * size + place, value)
        open_sets = (signature.reshape(n_sets, size).max(1) >> np.uint64(54)) > np.uint64(j)
        going = open_sets[owner]
        if not going.all():
            seed, owner, state = seed[going], owner[going], state[going]
    return signature.reshape(n_sets, size)


def _groups(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of sets with about ``limit`` elements in all."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1)
        yield at, to
        at = to


def _set_keys(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set, whatever the order of its elements; null for the empty set."""
    halves = []
    for salt in (np.uint64(0x51ED270B), np.uint64(0xC2B2AE3D)):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(sets + salt), dtype=np.uint64)])
        halves.append(mixed(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)))
    joined = np.stack(halves, 1).astype(">u8").tobytes()
    sizes = np.diff(bounds)
    return [joined[i * 16 : i * 16 + 16] if sizes[i] else None for i in range(len(sizes))]


def _sketcher(words: int):
    size = BANDS * BAND_ROWS

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES // 2):
            sets, bounds = shingle_sets(batch.column("text"), words)
            n = len(bounds) - 1
            bands = np.zeros((n, BANDS), np.int64)
            short = np.zeros((n, size), np.uint8)
            for a, b in _groups(bounds, 1 << 17):
                part = super_minhash(sets[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], size)
                short[a:b] = mixed(part) & np.uint64(0xFF)
                key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None], b - a, 0)
                for i in range(BAND_ROWS):
                    key = mixed(key * np.uint64(_GOLDEN) + part[:, i::BAND_ROWS])
                bands[a:b] = key.view(np.int64)
            flat = short.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("text_key"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(_set_keys(sets, bounds), pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(bands.ravel())
                    ),
                    pa.array([flat[i * size : i * size + size] for i in range(n)], pa.binary()),
                ],
                names=["id", "text_key", "n_shingles", "set_key", "bands", "signature"],
            )
            del sets, bands, short, flat
            trim()

    return sketch


def _set_reader(words: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES // 2):
            sets, bounds = shingle_sets(batch.column("text"), words)
            raw = sets.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_set_keys(sets, bounds), pa.binary()),
                    pa.array([raw[a * 8 : b * 8] for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ],
                names=["set_key", "members"],
            )
            del sets, raw
            trim()

    return read


def _common():
    """Sizes of the intersections of two columns of ascending sets."""

    @F.arrow_udf("long")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(
            [
                np.intersect1d(
                    np.frombuffer(x.as_buffer(), np.uint64),
                    np.frombuffer(y.as_buffer(), np.uint64),
                    assume_unique=True,
                ).size
                for x, y in zip(a, b)
            ],
            pa.int64(),
        )

    return common


def _agreeing(percent: int) -> int:
    """Values of two signatures that must agree before sets are fetched.

    Six standard deviations of the (larger) variance of independent values
    below the threshold: a linked pair fails once in 10^9.
    """
    size, p = BANDS * BAND_ROWS, percent / 100
    return max(0, int(size * p - 6 * (size * p * (1 - p)) ** 0.5))


def _likely(percent: int):
    least = _agreeing(percent)

    @F.arrow_udf("boolean")
    def likely(a: pa.Array, b: pa.Array) -> pa.Array:
        size = BANDS * BAND_ROWS
        x, y = (
            np.frombuffer(b"".join(v.to_pylist()), np.uint8).reshape(len(v), size) for v in (a, b)
        )
        return pa.array((x == y).sum(1) >= least)

    return likely


def _tiles(percent: int):
    """Links between different components within runs of one tile pair.

    Pairs that sizes or signatures exclude are skipped, and so are pairs that
    links found before already connect; all others are compared on full sets.
    """
    least = _agreeing(percent)
    size = BANDS * BAND_ROWS

    def links_of(table: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        keys = table.column("set_key").to_pylist()
        part = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)[1]
        side = np.asarray(table.column("side"))
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in table.column("members")]
        sizes = np.array([len(m) for m in sets])
        values = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8)
        values = values.reshape(len(keys), size)
        right = np.flatnonzero(side != 1)
        for i in np.flatnonzero(side != 2):
            others = right[right > i] if side[i] == 0 else right
            others = others[part[others] != part[i]]
            n, m = sizes[i], sizes[others]
            others = others[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
            agree = (values[others] == values[i]).sum(1)
            likely = np.flatnonzero(agree >= least)
            for k in others[likely[np.argsort(-agree[likely], kind="stable")]]:
                if part[k] != part[i]:
                    common = np.intersect1d(sets[i], sets[k], assume_unique=True).size
                    if 100 * common >= percent * (sizes[i] + sizes[k] - common):
                        part[part == part[k]] = part[i]
                        yield min(keys[i], keys[k]), max(keys[i], keys[k])

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tile = np.asarray(table.column("tile"))
        cuts = np.flatnonzero(np.diff(tile)) + 1
        found: set = set()
        for a, b in zip([0, *cuts], [*cuts, len(tile)]):
            if b - a > 1:
                found.update(links_of(table.slice(a, b - a)))
        if found:
            u, v = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"]
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "tile"):
            yield from emit(table)

    return run


class _Run:
    """One call: tables that several steps share."""

    def __init__(self, docs: DataFrame, id: str, text: str, words: int, percent: int) -> None:
        self.scratch = Scratch(docs.sparkSession)
        self.words, self.percent = words, percent
        self.texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
        keyed = self.texts.select("id", "text", F.xxhash64("text").alias("text_key"))
        id_type = self.texts.schema["id"].dataType.simpleString()
        self.rows = self.scratch.store(
            keyed.mapInArrow(
                _sketcher(words),
                f"id {id_type}, text_key long, n_shingles long, set_key binary,"
                " bands array<long>, signature binary",
            )
        )
        self.classes = self.scratch.store(
            self.rows.filter("set_key IS NOT NULL")
            .groupBy("set_key")
            .agg(
                # one of its rows, of the smallest id if there is any
                F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("row"),
                F.first("n_shingles").alias("n_shingles"),
                F.first("bands").alias("bands"),
                F.first("signature").alias("signature"),
            )
        )

    def buckets(self) -> DataFrame:
        """Members of all buckets with more than one class."""
        members = self.classes.select("set_key", F.explode("bands").alias("bucket"))
        leaders = (
            members.groupBy("bucket")
            .agg(
                F.min("set_key").alias("leader"),
                F.max("set_key").alias("last"),
                F.count("*").alias("n"),
            )
            .filter("leader <> last")
            .drop("last")
        )
        return members.join(leaders, "bucket")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and signatures allow the similarity."""
        about = self.classes.select("set_key", "n_shingles", "signature")
        a = about.toDF("u", "n_u", "s_u")
        b = about.toDF("v", "n_v", "s_v")
        return (
            pairs.join(a, "u")
            .join(b, "v")
            .filter(F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * self.percent)
            .filter(_likely(self.percent)("s_u", "s_v"))
            .select("u", "v")
        )

    def sets(self, keys: DataFrame) -> DataFrame:
        """Full sets of the classes in ``keys(set_key)``, from one text of each."""
        rows = self.classes.join(keys, "set_key", "left_semi").select(
            F.col("row.id").alias("row_id"), F.col("row.text_key").alias("row_key")
        )
        same = F.col("id").eqNullSafe(F.col("row_id")) & (F.xxhash64("text") == F.col("row_key"))
        return (
            self.texts.join(rows, same, "left_semi")
            .mapInArrow(_set_reader(self.words), "set_key binary, members binary")
            .join(keys, "set_key", "left_semi")
            .dropDuplicates(["set_key"])
        )

    def linked(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full sets reach the threshold."""
        a = sets.toDF("u", "m_u")
        b = sets.toDF("v", "m_v")
        both = pairs.join(a, "u").join(b, "v")
        sizes = (F.octet_length("m_u") + F.octet_length("m_v")) / 8
        return (
            both.select("u", "v", _common()("m_u", "m_v").alias("common"), sizes.cast("long").alias("all"))
            .filter(F.col("common") * 100 >= (F.col("all") - F.col("common")) * self.percent)
            .select("u", "v")
        )

    def components(self) -> DataFrame:
        """``(node, root)`` of all classes that are linked with others.

        Round one compares each member of a bucket with the bucket's first
        class. Round two compares, within a bucket, members that are still in
        different components, tile by tile.
        """
        buckets = self.scratch.store(self.buckets())
        star = (
            buckets.filter("set_key <> leader")
            .select(F.col("leader").alias("u"), F.col("set_key").alias("v"))
            .distinct()
        )
        likely = self.scratch.store(self.likely(star))
        wanted = likely.select(F.col("u").alias("set_key")).union(likely.select("v"))
        wanted = wanted.union(buckets.filter("n > 2").select("set_key")).distinct()
        sets = self.scratch.store(self.sets(wanted))
        first = self.scratch.store(self.linked(likely, sets))
        roots = self.scratch.store(components(first, self.scratch))
        about = self.classes.select("set_key", "n_shingles", "signature")
        rooted = (
            buckets.filter("n > 2")
            .join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
            .withColumn("root", F.coalesce("root", "set_key"))
            .join(about, "set_key")
        )
        n = F.greatest(
            F.ceil(F.count("*") / TILE), F.ceil(F.sum("n_shingles") / TILE_SHINGLES)
        ).cast("int")
        split = (
            rooted.groupBy("bucket")
            .agg(F.min("root").alias("low"), F.max("root").alias("high"), n.alias("n_tiles"))
            .filter("low <> high")
            .select("bucket", "n_tiles")
        )
        other = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1))
        tiled = (
            rooted.join(split, "bucket")
            .withColumn("own", F.pmod(F.xxhash64("set_key", "bucket"), "n_tiles").cast("int"))
            .withColumn("other", other)
            .withColumn(
                "side", F.expr("CASE WHEN own = other THEN 0 WHEN own < other THEN 1 ELSE 2 END")
            )
            .withColumn("tile", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
            .join(sets, "set_key")
            .select("tile", "side", "set_key", "root", "signature", "members")
        )
        second = self.scratch.store(
            tiled.repartition("tile")
            .sortWithinPartitions("tile")
            .mapInArrow(_tiles(self.percent), "u binary, v binary")
            .distinct()
        )
        joined = roots.filter("node <> root").select(F.col("root").alias("u"), F.col("node").alias("v"))
        return components(joined.unionByName(second), self.scratch)


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: its component and whether it stays.

    Returns ``doc_id, text_key, n_shingles, component_id, group_key, kept``. Texts are
    linked if ``100 * |A and B| >= percent * |A or B|`` for their sets of
    ``words``-word shingles; ``component_id`` is the smallest id reachable,
    ``kept`` marks the row that bears it. ``text_key`` tells apart rows that
    repeat an id with different texts, ``group_key`` names the component also
    where ids do not. A text that is null, empty or without
    words has no shingles and is linked with nothing. A null id counts as
    larger than all others. Repeated rows give repeated rows. Other columns of
    ``docs`` play no part. Buckets of any size are worked on in tiles; no
    candidates are dropped.
    """
    run = _Run(docs, id, text, words, percent)
    roots = run.components()
    grouped = (
        run.classes.select("set_key", F.col("row.id").alias("id"))
        .join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
        .withColumn("root", F.coalesce("root", "set_key"))
    )
    least = grouped.groupBy("root").agg(F.min("id").alias("component_id"))
    classes = run.scratch.store(grouped.join(least, "root").select("set_key", "root", "component_id"))
    out = run.scratch.store(
        run.rows.select("id", "text_key", "n_shingles", "set_key")
        .join(classes, "set_key", "left")
        .select(
            F.col("id").alias("doc_id"),
            "text_key",
            "n_shingles",
            F.when(F.col("set_key").isNull(), F.col("id"))
            .otherwise(F.col("component_id"))
            .alias("component_id"),
            F.col("root").alias("group_key"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    run.scratch.drop(out)
    return out
