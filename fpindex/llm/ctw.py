"""Language-model scores by context-tree weighting over bytes.

A text is read as its words in lower case, each with a space behind it, and an
end. Each byte is eight binary decisions. A decision under a context of 0 to
``depth`` bytes is a node with counts of zeros and ones, estimated by
Krichevsky and Trofimov; a node's probability is half its own estimate and half
the product of its children, whose contexts are one byte longer. A text is
scored with the mixture over all depths that follows from it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.llm.scratch import Scratch
from fpindex.llm.texts import mixed, small_batches, word_hashes, words_at
from fpindex.llm.workers import kept, trim, whole_groups

#: Bytes of context; with the byte itself at most 7.
DEPTH = 5
#: Entries of the model, and words, that a task holds at once. Larger models
#: are scored with in several passes, one part of the model each.
PART_ENTRIES = 5_000_000
_END, _PAD = 10, 8
_TEXT_BYTES = 2 << 20
#: Bytes of text and grams scored at once; scoring takes some hundred times their room.
_SCORED = 1 << 20
#: Counts that a task gathers before it merges them.
_GATHERED = 1 << 20


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts with ends before and behind, places of the symbols, bounds of each text in them."""
    data, starts, ends, bounds = words_at(texts)
    size = ends - starts
    n = len(bounds) - 1
    words = np.diff(bounds)
    owner = np.repeat(np.arange(n), words)
    before = np.concatenate([[0], np.cumsum(size + 1)])
    # a text has _PAD ends before it and one behind it
    shift = _PAD * (owner + 1) + owner
    place = before[:-1] + shift
    out = np.full(int(before[-1]) + (_PAD + 1) * n, _END, np.uint8)
    out[place + size] = 32
    inside = np.repeat(starts, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(place - starts, size) + inside] = data[inside]
    lengths = before[bounds[1:]] - before[bounds[:-1]] + 1
    edges = np.concatenate([[0], np.cumsum(lengths)])
    at = np.arange(edges[-1]) + np.repeat(_PAD * np.arange(1, n + 1), lengths)
    return out, at, edges


def grams_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes up to each place as one number, the last byte lowest."""
    if not len(at):
        return np.zeros(0, np.uint64)
    view = np.ndarray((len(data) - 7,), ">u8", data.data, strides=(1,))
    return view[at - 7].astype(np.uint64) & np.uint64((1 << 8 * size) - 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    shifted = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series
    return shifted - sum(np.log(x + k) for k in range(8))


def log_estimate(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log probability of the counts by Krichevsky and Trofimov."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth, by key: context bytes and the bits of the byte so far."""

    def __init__(self, keys, n0, n1, below, leaf: bool = False) -> None:
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = log_estimate(n0, n1)
        self.log = own if leaf else np.logaddexp(own, below) - np.log(2)
        self.share = np.ones(len(keys)) if leaf else np.exp(own - np.log(2) - self.log)
        self.one = (n1 + 0.5) / (n0 + n1 + 1.0)

    def up(self, depth: int) -> tuple[Level, np.ndarray]:
        """The nodes one byte less deep, ``depth`` bytes, and for each node here its parent."""
        parents = self.keys & np.uint64((1 << 8 * (depth + 1)) - 1)
        keys, of = np.unique(parents, return_inverse=True)
        sums = [np.bincount(of, w, len(keys)) for w in (self.n0, self.n1, self.log)]
        return Level(keys, *sums), of


def leaves(grams: np.ndarray, counts: np.ndarray) -> Level:
    """Nodes of full depth from grams of a context and a byte."""
    context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
    keys, ones, zeros = [], [], []
    for i in range(8):
        node = (1 << i) | (byte >> (8 - i))
        bit = (byte >> (7 - i)) & 1
        keys.append((context << np.uint64(8)) | node.astype(np.uint64))
        ones.append(np.where(bit == 1, counts, 0))
        zeros.append(np.where(bit == 0, counts, 0))
    keys, of = np.unique(np.concatenate(keys), return_inverse=True)
    n0, n1 = (np.bincount(of, np.concatenate(x), len(keys)) for x in (zeros, ones))
    return Level(keys, n0, n1, None, leaf=True)


def tree(grams: np.ndarray, counts: np.ndarray, depth: int) -> list[Level]:
    """Levels from ``depth`` to 2 of all contexts that end in the same two bytes as ``grams``."""
    levels = [leaves(grams, counts)]
    for d in range(depth - 1, 1, -1):
        level, of = levels[-1].up(d)
        levels[-1].parent = of
        levels.append(level)
    return levels


def chances(levels: list[Level]) -> list[np.ndarray]:
    """For each node the mixture from depth 2 down to it, with one half below it."""
    out = []
    for i, level in enumerate(levels):
        q = level.share * level.one + (1 - level.share) * 0.5
        of = np.arange(len(level.keys))
        for lower, upper in zip(levels[i:], levels[i + 1 :]):
            of = lower.parent[of]
            q = upper.share[of] * upper.one[of] + (1 - upper.share[of]) * q
        out.append(q)
    return out


class Counter:
    """Counts of keys, merged whenever many have come together."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(np.unique(values, return_counts=True))
        if sum(len(k) for k, _ in self.waiting) > max(_GATHERED, len(self.keys)):
            self.merge()

    def merge(self) -> None:
        keys, counts = zip((self.keys, self.counts), *self.waiting)
        self.waiting = []
        keys, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts, first) if len(first) else counts

    def batches(self, kind: str) -> Iterator[pa.RecordBatch]:
        self.merge()
        for a in range(0, len(self.keys), 50_000):
            part = self.keys[a : a + 50_000].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(part)), pa.array(part), pa.array(self.counts[a : a + 50_000])],
                names=["kind", "key", "n"],
            )


def _counting(depth: int):
    """Grams and words of training texts, counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, words = Counter(), Counter()
        for batch in small_batches(batches, "text", _TEXT_BYTES):
            texts = batch.column("text")
            data, at, _ = symbols(texts)
            grams.add(grams_at(data, at, depth + 1))
            words.add(word_hashes(texts)[0])
        yield from grams.batches("gram")
        yield from words.batches("word")

    return run


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.asarray(table.column("key")).view(np.uint64)
    return keys, np.asarray(table.column("n")).astype(float)


def _heads(depth: int):
    """Counts and log probabilities of the nodes of depth 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "ending"):
            top = tree(*_arrays(table), depth)[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.keys.view(np.int64)), pa.array(top.n0), pa.array(top.n1), pa.array(top.log)],
                names=["key", "n0", "n1", "log"],
            )

    return run


class Top:
    """Mixture of depths 0 and 1: a decision of chance ``q`` below has chance ``add + part * q``."""

    def __init__(self, keys, n0, n1, log) -> None:
        one = Level(keys, n0, n1, log)
        zero, of = one.up(0)
        self.add = np.zeros((256, 256))
        self.part = np.ones((256, 256))
        share = np.zeros(256)
        chance = np.full(256, 0.5)
        node = zero.keys.astype(np.int64)
        share[node], chance[node] = zero.share, zero.one
        self.add[:] = share * chance
        self.part[:] = 1 - share
        context, node = (one.keys >> np.uint64(8)).astype(np.int64), (one.keys & np.uint64(255)).astype(np.int64)
        self.add[context, node] += self.part[context, node] * one.share * one.one
        self.part[context, node] *= 1 - one.share


def _model(depth: int, add: np.ndarray, part: np.ndarray):
    """Entries of the model: log10 of the chance of seen grams, and ``leaning`` chances of nodes by depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "ending"):
            grams, counts = _arrays(table)
            levels = tree(grams, counts, depth)
            found = []
            for d, level, q in zip(range(depth, 1, -1), levels, chances(levels)):
                node = (level.keys & np.uint64(255)).astype(np.int64)
                last = ((level.keys >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
                found.append((d, level.keys, add[last, node] + part[last, node] * q))
            found.append((0, grams, gram_logs(grams, found[0][1], found[0][2])))
            for d, keys, values in found:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), d, np.int32)),
                        pa.array(keys.view(np.int64)),
                        pa.array(leaning(values) if d else values),
                        pa.array(ending(keys >> np.uint64(8)).view(np.int64)),
                    ],
                    names=["depth", "key", "value", "ending"],
                )

    return run


def ending(contexts: np.ndarray) -> np.ndarray:
    """The last two bytes of contexts; what shares them is worked on together."""
    return contexts & np.uint64(0xFFFF)


def leaning(one: np.ndarray) -> np.ndarray:
    """The smaller of the chances of a one and a zero, that of a zero with a minus: exact near both ends if narrowed."""
    return np.where(one > 0.5, one - 1, one)


def bit_logs(leaning: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """log10 of the chances of ``bits``."""
    small = np.abs(leaning.astype(float))
    return np.log10(np.where((leaning < 0) == (bits == 1), 1 - small, small))


def gram_logs(grams: np.ndarray, keys: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """log10 of the chance of each gram's byte from the chances of its eight nodes."""
    context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
    total = np.zeros(len(grams))
    for i in range(8):
        node = ((1 << i) | (byte >> (8 - i))).astype(np.uint64)
        p = chance[np.searchsorted(keys, (context << np.uint64(8)) | node)]
        total += np.log10(np.where((byte >> (7 - i)) & 1, p, 1 - p))
    return total


class Lookup:
    """A hash table from 64-bit keys to numbers: places in the arrays that are given, which are not copied."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(1.5 * len(keys)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = keys, values
        self.slots = np.full(1 << bits, -1, np.int32)
        place = mixed(keys) & self.mask
        rest = np.arange(len(keys), dtype=np.int32)
        while len(rest):
            free = rest[self.slots[place[rest]] < 0]
            self.slots[place[free]] = free
            rest = rest[self.slots[place[rest]] != rest]
            place[rest] = (place[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys are there."""
        values, hit = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        if not len(self.keys):
            return values, hit
        place = mixed(keys) & self.mask
        rest = np.arange(len(keys))
        while len(rest):
            at = self.slots[place[rest]]
            same = (at >= 0) & (self.keys[at] == keys[rest])
            values[rest[same]], hit[rest[same]] = self.values[at[same]], True
            rest = rest[~same & (at >= 0)]
            place[rest] = (place[rest] + np.uint64(1)) & self.mask
        return values, hit


class Part:
    """The part of a model that one pass scores with."""

    def __init__(self, state: dict) -> None:
        self.depth, self.n_parts, self.part = state["depth"], state["n_parts"], state["part"]
        self.add, self.below = state["add"], state["below"]
        self.grams = Lookup(state[0]["key"], state[0]["value"])
        self.levels = {d: (state[d]["key"], state[d]["value"]) for d in range(2, self.depth + 1)}
        self.words = state["words"]["key"], state["words"]["value"]
        self.ends, self.total = state["ends"], state["total"]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """How often words of this part occur in the training texts."""
        keys, counts = self.words
        if not len(keys):
            return np.zeros(len(hashes), np.int64)
        odd, back = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, odd), len(keys) - 1)
        return np.where(keys[at] == odd, counts[at], 0)[back]

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys) % np.uint64(self.n_parts) == np.uint64(self.part)

    def unseen(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the chances of grams that are not in the model."""
        context, byte = grams >> np.uint64(8), (grams & np.uint64(255)).astype(np.int64)
        last = (context & np.uint64(255)).astype(np.int64)
        total = np.zeros(len(grams))
        for i in range(8):
            node = (1 << i) | (byte >> (8 - i))
            p = leaning(self.add[last, node] + self.below[last, node] * 0.5)
            open_ = np.arange(len(grams))
            for d in range(self.depth, 1, -1):
                keys, values = self.levels[d]
                if not len(keys):
                    continue
                key = ((context[open_] & np.uint64((1 << 8 * d) - 1)) << np.uint64(8)) | node[open_].astype(np.uint64)
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = keys[at] == key
                p[open_[same]] = values[at[same]]
                open_ = open_[~same]
            total += bit_logs(p, (byte >> (7 - i)) & 1)
        return total

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """log10 of the chances of grams of this part, 0 for others."""
        out = np.zeros(len(grams))
        for a in range(0, len(grams), _SCORED):
            out[a : a + _SCORED] = self._logs(grams[a : a + _SCORED])
        return out

    def _logs(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        own = slice(None) if self.n_parts == 1 else np.flatnonzero(self.mine(ending(grams >> np.uint64(8))))
        values, hit = self.grams.find(grams[own])
        missing = np.flatnonzero(~hit)
        if len(missing):
            odd, back = np.unique(grams[own][missing], return_inverse=True)
            values[missing] = self.unseen(odd)[back]
        out[own] = values
        return out


def _scoring(model, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = kept(name, lambda: Part({**model["plain"].value, **{k: b.value for k, b in model.items()}}))
        trim()
        first = part.part == 0
        for batch in small_batches(batches, "text", _SCORED):
            texts = batch.column("text")
            data, at, edges = symbols(texts)
            scores = np.concatenate([[0.0], np.cumsum(part.logs(grams_at(data, at, part.depth + 1)))])
            hashes, bounds = word_hashes(texts)
            count = part.count(hashes)
            known = np.concatenate([[0], np.cumsum(count > 0)])
            logs = np.concatenate([[0.0], np.cumsum(np.log10(count + 1.0))])
            n = np.diff(bounds) + 1
            base = np.diff(logs[bounds])
            if first:
                base += np.log10(part.ends + 1.0) - n * np.log10(part.total)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    batch.column("held_out"),
                    pa.array(n, pa.int64()),
                    pa.array(np.diff(known[bounds]) + (first and part.ends > 0), pa.int64()),
                    pa.array(base),
                    pa.array(np.diff(scores[edges])),
                    pa.array(edges[1:] - edges[:-1], pa.int64()),
                ],
                names=["doc_id", "text_key", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes"],
            )
            del data, at, scores, hashes, count, known, logs
            trim()

    return run


def held_out(id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into ``fold``; never for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_texts(
    docs: DataFrame,
    folds: int = 7,
    fold: int = 2,
    depth: int = DEPTH,
    part_entries: int = PART_ENTRIES,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Scores of all rows by a model learnt from those not held out.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, bits_per_byte``. ``score`` is the log10 probability of the text as
    the model reads it (words in lower case, single spaces, an end),
    ``bits_per_byte`` its code length over its bytes; ``base_score`` is the sum
    over words and the end of log10((c + 1) / (N + V + 1)). A null, empty or
    blank text is its end alone. A row with a null id is never held out.
    Without training rows all chances are one half. Repeated rows give repeated
    rows; other columns play no part.

    Counts cover all training rows and are never cut; words are told apart by
    64-bit hashes. A task holds at most ``part_entries`` of them and of the
    model's nodes: what is beyond is scored in further passes.
    """
    if not 2 <= depth <= 6:
        raise ValueError("depth must be from 2 to 6")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(
        F.col(id).alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        held_out(F.col(id), folds, fold).alias("held_out"),
        F.col(text).alias("text"),
    )
    training = rows.filter(~F.col("held_out")).select("text")
    counted = scratch.store(
        training.mapInArrow(_counting(depth), "kind string, key long, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    n_docs = rows.filter(~F.col("held_out")).count()
    sizes = {r["kind"]: r for r in counted.groupBy("kind").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect()}
    words = sizes["word"] if "word" in sizes else {"v": 0, "n": 0}
    n_tokens = words["n"] + n_docs
    vocabulary = words["v"] + (n_docs > 0)
    grouped = (
        counted.filter("kind = 'gram'")
        .select("key", "n", F.expr("shiftright(key, 8) & 65535").alias("ending"))
        .repartition("ending")
        .sortWithinPartitions("ending", "key")
    )
    heads = grouped.mapInArrow(_heads(depth), "key long, n0 double, n1 double, log double")
    # at most 256 contexts of one byte with 255 nodes each
    firsts = (
        heads.groupBy(F.expr("key & 65535").alias("key"))
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("log").alias("log"))
        .orderBy("key")
        .toPandas()
    )
    top = Top(firsts["key"].to_numpy(np.int64).view(np.uint64), *(firsts[c].to_numpy(float) for c in ("n0", "n1", "log")))
    model = scratch.store(
        grouped.mapInArrow(_model(depth, top.add, top.part), "depth int, key long, value double, ending long")
    )
    n_parts = max(1, -(-max(model.count(), words["v"]) // part_entries))
    passes = None
    for part in range(n_parts):
        state = {"depth": depth, "n_parts": n_parts, "part": part, "add": top.add, "below": top.part}
        state |= {"ends": n_docs, "total": float(n_tokens + vocabulary + 1)}
        # one table after another, so that the driver holds no more than one
        shared = {"plain": spark.sparkContext.broadcast(state)}
        for d in (0, *range(2, depth + 1)):
            chosen = model.filter(F.col("depth") == d).select("key", "value", "ending")
            table = _collected(chosen, "ending", n_parts, part, np.float32 if d else np.float64)
            shared[d] = spark.sparkContext.broadcast(table)
            del table
        counts = counted.filter("kind = 'word'").select("key", F.col("n").alias("value"))
        shared["words"] = spark.sparkContext.broadcast(_collected(counts, "key", n_parts, part, np.int64))
        scored = rows.mapInArrow(
            _scoring(shared, uuid.uuid4().hex),
            f"doc_id {kind}, text_key long, held_out boolean, n_tokens long, n_known long,"
            " base double, score double, n_bytes long",
        )
        done = scratch.store(scored.withColumn("pass", F.lit(part)))
        passes = done if passes is None else passes.unionByName(done)
    key = ["doc_id", "text_key", "held_out", "n_tokens", "n_bytes"]
    each = passes.groupBy(*key, "pass").agg(
        F.first("n_known").alias("n_known"), F.first("base").alias("base"),
        F.first("score").alias("score"), F.count("*").alias("copies"),
    )
    return (
        each.groupBy(*key)
        .agg(
            F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"),
            F.sum("score").alias("score"), F.max("copies").alias("copies"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"),
            "base_score", "score", (-F.col("score") / np.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
        )
    )


def _collected(entries: DataFrame, by: str, n_parts: int, part: int, kind) -> dict[str, np.ndarray]:
    """One part of a table of keys and values in ascending order, of bounded size."""
    if n_parts > 1:
        entries = entries.mapInArrow(_of_part(by, n_parts, part), entries.schema)
    table = entries.select("key", "value").toArrow()
    parts = [
        (np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).astype(kind)) for b in table.to_batches()
    ]
    del table
    keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in parts]])
    values = np.concatenate([np.zeros(0, kind), *[v for _, v in parts]])
    del parts
    order = np.argsort(keys)
    return {"key": keys[order], "value": values[order]}


def _of_part(by: str, n_parts: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(by)).view(np.uint64)
            yield batch.filter(pa.array(mixed(keys) % np.uint64(n_parts) == np.uint64(part)))

    return run
