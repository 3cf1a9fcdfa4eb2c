"""Texts in Arrow batches: words and chunks as numpy arrays.

A *word* is a run of bytes other than space and 0x09-0x0D. A *chunk* is a word
with the white space before it, or white space at the end of a text. Natural
texts repeat their chunks, so costly work is done once per distinct chunk of
a batch and carried to all places by its code.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WHITE = b" \t\n\x0b\x0c\r"
#: Only A-Z change; other letters stay as they are.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.isin(np.arange(256), list(WHITE))
#: Bytes of text worked on at once; a single longer text is worked on alone.
BATCH_BYTES = 16 << 20


class Chunks(NamedTuple):
    """Chunk ``i`` of the batch is ``values[codes[i]]``; text ``d`` has chunks ``bounds[d]:bounds[d + 1]``."""

    codes: np.ndarray
    bounds: np.ndarray
    values: list[bytes]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each starts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(np.asarray(sizes, np.int64)) if batch.num_rows else np.zeros(0)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_SIGN = np.array([33 <= b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])


def chunk_starts(data: np.ndarray, offsets: np.ndarray, cut_at: str = "white") -> np.ndarray:
    """Where chunks start: at each text, and where ``cut_at`` says.

    * ``white``: where white space follows a word;
    * ``space``: where a space follows anything but a space;
    * ``pattern``: where white space follows a word, but not after a character
      that Unicode may count as white space too (or that shares its lead
      byte), and where a sign other than an apostrophe follows A-Z or a-z.
    """
    space = IS_SPACE[data] if cut_at != "space" else data == 32
    cut = np.zeros(len(data), bool)
    np.logical_and(space[1:], ~space[:-1], out=cut[1:])
    if cut_at == "pattern" and len(data) > 2:
        cut[2:] &= data[:-2] != 0xC2
        cut[3:] &= ~((data[:-3] >= 0xE1) & (data[:-3] <= 0xE3))
        cut[1:] |= _LETTER[data[:-1]] & _SIGN[data[1:]]
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(cut)


def chunks_of(texts: pa.Array, cut_at: str = "white") -> Chunks:
    """All chunks of a batch of texts."""
    data, offsets = flat(texts)
    starts = chunk_starts(data, offsets, cut_at)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Chunks(np.zeros(0, np.int32), bounds, [])
    ends = np.append(starts, len(data)).astype(np.int64)
    array = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]
    )
    coded = array.dictionary_encode()
    return Chunks(np.asarray(coded.indices), bounds, coded.dictionary.to_pylist())


def word_of(chunk: bytes) -> bytes:
    """The word of a chunk with A-Z in lower case; empty for white space alone."""
    return chunk.translate(LOWER, WHITE)


_ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.frombuffer(LOWER, np.uint8)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words longer than this are hashed one by one.
_LONG_WORD = 512


def words_at(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes (with 8 zeros behind), starts and ends of all words, bounds of each text."""
    data, offsets = flat(texts)
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_LOWER, data, out=padded[: len(data)])
    word = ~IS_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[edges] = word[edges]
    edges = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    last[edges] = word[edges]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return padded, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of a batch, and the bounds of each text in them."""
    padded, starts, ends, bounds = words_at(texts)
    length = ends - starts
    window = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    value = mixed(
        (window[starts] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(_ODD)
    )
    rest, k = np.flatnonzero((length > 8) & (length <= _LONG_WORD)), 8
    while len(rest):
        piece = window[starts[rest] + k] & _MASKS[np.minimum(length[rest] - k, 8)]
        value[rest] = mixed(value[rest] * np.uint64(_ODD) + piece)
        k += 8
        rest = rest[length[rest] > k]
    for i in np.flatnonzero(length > _LONG_WORD):
        value[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]])
    return value, bounds


def segment_ids(bounds: np.ndarray) -> np.ndarray:
    """For each item of consecutive segments the number of its segment."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums over consecutive segments, some of which may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]
