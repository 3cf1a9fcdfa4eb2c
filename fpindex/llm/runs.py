"""Periodic runs of words: stretches that repeat themselves with a period.

A *run* is a stretch of consecutive words with smallest period ``q`` (words
``q`` apart are identical) and at least ``max(least, 2 * q)`` words, which no
neighbouring word extends keeping the period.

Words are cut into blocks of 2, 4, 8, ... words. A run of period ``q`` holds a
whole block together with the same block ``q`` words later, if blocks have at
most ``(q + 1) / 2`` words; so blocks of ``B`` words are responsible for the
periods ``2 B - 1`` to ``4 B - 2`` (those of two words for 1 to 6, as a run has
12 words at least). The block is laid over its following window at all these
distances at once: the sums of squared differences of word numbers are one
convolution, computed exactly by number-theoretic transforms. A sum of zero is
an occurrence, and its distance the seed of a run, which is then extended word
by word. The work is about ``n log(n)^2`` for a text of ``n`` words, whatever
its periods are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.llm.texts import WHITE, chunks_of, segment_ids, small_batches

#: A run has at least so many words; blocks of two words find periods up to 6 because of it.
LEAST_WORDS = 12
#: Primes p with p - 1 divisible by 2^23 at least; 3 is a primitive root of each.
PRIMES = (998244353, 469762049, 167772161)
#: Elements of one transform (blocks times length).
SLAB = 1 << 20
#: Bytes of text worked on at once; a single longer text is worked on alone.
RUN_BATCH = 4 << 20


class Runs(NamedTuple):
    """Run ``i`` has ``length[i]`` words from word ``start[i]`` on, of smallest period ``period[i]``."""

    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


@lru_cache(maxsize=64)
def _roots(p: int, half: int) -> np.ndarray:
    """Powers 0 to ``half - 1`` of a root of unity of order ``2 * half``."""
    powers, step = np.ones(1, np.uint64), pow(3, (p - 1) // (2 * half), p)
    while len(powers) < half:
        powers = np.concatenate([powers, powers * np.uint64(pow(step, len(powers), p)) % np.uint64(p)])
    return powers[:half, None]


@lru_cache(maxsize=64)
def _inverse_roots(p: int, half: int) -> np.ndarray:
    powers = _roots(p, half)
    return np.concatenate([powers[:1], np.uint64(p) - powers[:0:-1]]) if half > 1 else powers


def _reduced(x: np.ndarray, p: np.uint64) -> np.ndarray:
    """``x mod p``; dividing by one number and multiplying back is faster than a remainder."""
    return x - x // p * p


def transform(a: np.ndarray, p: int) -> np.ndarray:
    """Transform of every column of ``a`` modulo ``p``, in bit-reversed order."""
    prime, n = np.uint64(p), len(a)
    half = n // 2
    while half:
        pairs = a.reshape(-1, 2, half, a.shape[1])
        u, v = pairs[:, 0], pairs[:, 1]
        low, high = u + v, u + (prime - v)
        out = np.empty_like(pairs)
        np.minimum(low, low - prime, out=out[:, 0])
        out[:, 1] = _reduced(high * _roots(p, half), prime)
        a = out.reshape(n, -1)
        half //= 2
    return a


def inverse(a: np.ndarray, p: int) -> np.ndarray:
    """Inverse of :func:`transform`."""
    prime, n = np.uint64(p), len(a)
    half = 1
    while half < n:
        pairs = a.reshape(-1, 2, half, a.shape[1])
        u, v = pairs[:, 0], _reduced(pairs[:, 1] * _inverse_roots(p, half), prime)
        low, high = u + v, u + (prime - v)
        out = np.empty_like(pairs)
        np.minimum(low, low - prime, out=out[:, 0])
        np.minimum(high, high - prime, out=out[:, 1])
        a = out.reshape(n, -1)
        half *= 2
    return _reduced(a * np.uint64(pow(n, -1, p)), prime)


def differences(blocks: np.ndarray, windows: np.ndarray, p: int) -> np.ndarray:
    """Sums of squared differences modulo ``p`` of each block to each place of its window.

    Blocks and windows are columns; row ``k`` of the result belongs to the
    window's words from ``k`` on.
    """
    prime, size = np.uint64(p), len(blocks)
    places = len(windows) - size + 1
    n = 1 << (len(windows) - 1).bit_length()
    blocks, windows = _reduced(blocks, prime), _reduced(windows, prime)
    a, b = np.zeros((n, blocks.shape[1]), np.uint64), np.zeros((n, blocks.shape[1]), np.uint64)
    a[:size], b[: len(windows)] = blocks[::-1], windows
    products = inverse(_reduced(transform(a, p) * transform(b, p), prime), p)[size - 1 : size - 1 + places]
    squares = np.zeros((len(windows) + 1, blocks.shape[1]), np.uint64)
    np.cumsum(_reduced(windows * windows, prime), axis=0, out=squares[1:])
    own = _reduced(blocks * blocks, prime).sum(axis=0)
    return _reduced(own + squares[size:] - squares[:places] + np.uint64(2) * (prime - products), prime)


def occurrences(blocks: np.ndarray, windows: np.ndarray, numbers: int) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(block, place)`` where a block stands in its window, word for word.

    A sum is less than the product of the primes that are used, so it is zero
    if it is zero modulo each. Blocks without a zero are left out of the next.
    """
    rows, bound, product = np.arange(blocks.shape[1]), len(blocks) * numbers**2, 1
    zero = np.zeros((len(windows) - len(blocks) + 1, 0), bool)
    for p in PRIMES:
        some = differences(blocks[:, rows], windows[:, rows], p) == 0
        zero = some if product == 1 else zero & some
        product *= p
        left = zero.any(axis=0)
        rows, zero = rows[left], zero[:, left]
        if product > bound or not len(rows):
            break
    place, column = np.nonzero(zero)
    return rows[column], place


def _same(x: np.ndarray, at: np.ndarray, shift: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, going by ``step``, equal the word ``shift`` later; ``room`` at most."""
    found, active, width = np.zeros(len(at), np.int64), np.flatnonzero(room > 0), 4
    while len(active):
        k = np.arange(width)
        inside = k < (room[active] - found[active])[:, None]
        place = np.where(inside, (at[active] + step * found[active])[:, None] + step * k, 0)
        equal = inside & (x[place] == x[np.where(inside, place + shift[active, None], 0)])
        more = np.where(equal.all(axis=1), width, equal.argmin(axis=1))
        found[active] += more
        active = active[more == width]
        width = max(1, min(2 * width, SLAB // max(1, len(active))))
    return found


class _Places:
    """Where the words of each text stand, to ask whether one comes again within some distance."""

    def __init__(self, x: np.ndarray, owner: np.ndarray, numbers: int) -> None:
        key = owner * numbers + x
        order = np.argsort(key, kind="stable")
        new = np.ones(len(x), bool)
        new[1:] = key[order[1:]] != key[order[:-1]]
        group = np.cumsum(new) - 1
        self._n = np.int64(len(x) + 1)
        self._sorted = group * self._n + order
        self._group = np.empty(len(x), np.int64)
        self._group[order] = group
        ends = np.append(np.flatnonzero(new)[1:], len(x)) - 1
        self.last = np.empty(len(x), np.int64)
        self.last[order] = order[ends[group]]

    def again(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word at each place stands ``low`` to ``high`` words later too."""
        first = self._group[at] * self._n + at + low
        next_ = np.searchsorted(self._sorted, first)
        found = self._sorted[np.minimum(next_, len(self._sorted) - 1)]
        return (next_ < len(self._sorted)) & (found <= first + (high - low)) & (found >= first)


def _recurring(starts: np.ndarray, size: int, low: int, high: int, places: _Places) -> np.ndarray:
    """Blocks all of whose words come again within the window; the others stand nowhere in it."""
    far = places.last - np.arange(len(places.last)) >= low
    done, width = 0, 1
    while done < size and len(starts):
        words = starts[:, None] + np.arange(done, min(size, done + width))
        starts = starts[far[words].all(axis=1)]
        done, width = done + width, 2 * width
    done, width = 0, 1
    while done < size and len(starts):
        words = starts[:, None] + np.arange(done, min(size, done + width))
        starts = starts[places.again(words.ravel(), low, high).reshape(words.shape).all(axis=1)]
        done, width = done + width, 2 * width
    return starts


def find_runs(x: np.ndarray, bounds: np.ndarray, least: int = LEAST_WORDS) -> Runs:
    """All runs of the texts ``x[bounds[i]:bounds[i + 1]]`` of word numbers, by start and period.

    Starts count from the first word of all texts. ``least`` is 12 or more.
    """
    if least < LEAST_WORDS:
        raise ValueError(f"runs have at least {LEAST_WORDS} words")
    bounds = np.asarray(bounds, np.int64)
    sizes, numbers = np.diff(bounds), int(x.max(initial=0)) + 2
    longest = int(sizes.max(initial=0))
    none = np.zeros(0, np.int64)
    if longest < least:
        return Runs(none, none, none)
    x = x.astype(np.int64)
    owner, ends = segment_ids(bounds), bounds[1:]
    places, reach = _Places(x, owner, numbers), np.zeros(len(x), np.int64)
    padded = np.append(x, numbers - 1).astype(np.uint64)  # a number no word has
    found, waiting, size = [], [], 2
    while 2 * (low := 1 if size == 2 else 2 * size - 1) <= longest:
        high = 4 * size - 2
        waiting, known = [r for r in waiting if r[2] > size], [r for r in waiting if r[2] <= size]
        for start, end, _ in known:
            np.maximum(reach[start:end], end, out=reach[start:end])
        counts = np.maximum(0, (sizes - low) // size)
        turn = np.arange(counts.sum()) - (np.cumsum(counts) - counts).repeat(counts)
        starts = bounds[:-1].repeat(counts) + size * turn
        # inside a run of period q <= size, nothing but multiples of q is found
        starts = starts[reach[starts] < np.minimum(starts + size + high, ends[owner[starts]])]
        starts = _recurring(starts, size, low, high, places)
        seeds = _seeds(padded, starts, size, low, high, ends[owner[starts]], numbers)
        new = _extended(x, *seeds, size, bounds, owner, reach, least)
        found.append(new)
        waiting += [(s, s + n, q) for s, n, q in new.tolist()]
        size *= 2
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)  # of equal stretches the smallest period
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[first]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    return Runs(rows[:, 0], rows[:, 1], rows[:, 2])


def _seeds(padded, starts, size, low, high, ends, numbers) -> tuple[np.ndarray, np.ndarray]:
    """Block starts and distances at which the block stands again."""
    at, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    width, step = high - low + size, max(1, SLAB // (4 * size))
    for a in range(0, len(starts), step):
        part, end = starts[a : a + step], ends[a : a + step]
        blocks = padded[part + np.arange(size)[:, None]]
        index = part + low + np.arange(width)[:, None]
        windows = padded[np.where(index < end, index, len(padded) - 1)]
        block, place = occurrences(blocks, windows, numbers)
        at.append(part[block])
        distance.append(place + low)
    return np.concatenate(at), np.concatenate(distance)


def _extended(x, at, distance, size, bounds, owner, reach, least) -> np.ndarray:
    """Runs ``(start, length, period)`` that seeds belong to; periods may be multiples of the smallest."""
    new = reach[at] < at + distance + size
    at, distance = at[new], distance[new]
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    text = owner[at]
    begins = np.ones(len(at), bool)  # neighbouring blocks at one distance are one seed
    begins[1:] = (distance[1:] != distance[:-1]) | (at[1:] != at[:-1] + size) | (text[1:] != text[:-1])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(at)) - 1
    low, high, q, text = at[first], at[last] + size, distance[first], text[first]
    low = low - _same(x, low - 1, q, low - bounds[text], -1)
    high = high + _same(x, high, q, bounds[text + 1] - q - high, 1)
    length = high - low + q
    kept = length >= np.maximum(least, 2 * q)
    return np.unique(np.stack([low, length, q], axis=1)[kept], axis=0)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, the bounds of each text, and the words."""
    chunks = chunks_of(texts)
    numbers: dict[bytes, int] = {}
    of_chunk = np.array([numbers.setdefault(v.lstrip(WHITE), len(numbers)) for v in chunks.values], np.int64)
    x = of_chunk[chunks.codes] if len(of_chunk) else np.zeros(0, np.int64)
    empty = numbers.get(b"", -1)
    kept = x != empty
    before = np.concatenate([[0], np.cumsum(kept)])
    return x[kept], before[chunks.bounds], list(numbers)


def _find(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", RUN_BATCH):
            x, bounds, words = _words(batch.column("text"))
            runs = find_runs(x, bounds, least)
            change = np.zeros(len(x) + 1, np.int64)
            np.add.at(change, runs.start + runs.period, 1)
            np.add.at(change, runs.start + runs.length, -1)
            kept = np.cumsum(change[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            numbers = x[kept].tolist()
            texts = [b" ".join([words[w] for w in numbers[a:b]]) for a, b in zip(left, left[1:])]
            of_text = np.searchsorted(runs.start, bounds)
            start = runs.start - bounds[segment_ids(of_text)]
            rows = pa.StructArray.from_arrays(
                [pa.array(start), pa.array(runs.length), pa.array(runs.period)], names=["start", "length", "period"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), rows),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    ``runs`` is an array of ``struct<start,length,period>`` in words from 0 on,
    ordered by start and period. ``collapsed`` are the words, joined by one
    space, without those that some run contains after its first period.

    A null, empty or blank text has no words, no runs and an empty ``collapsed``.
    Rows are judged one by one: repeated rows and null ids give a row each.
    Other columns are neither read nor returned. Texts are worked on where they
    are read, in batches of bounded bytes; nothing is shuffled.
    """
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _find(least),
        f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
    )
