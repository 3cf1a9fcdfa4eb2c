"""Character n-grams of words as numbers of hash buckets."""

from __future__ import annotations

import numpy as np

from fpindex.llm.texts import WHITE, mixed, word_of

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Words whose n-grams are held at once.
SLICE = 1 << 15


def words_in(chunks: list[bytes]) -> list[str]:
    """The word of each chunk with A-Z in lower case."""
    return [word_of(c).decode() for c in chunks]


def has_word(chunks: list[bytes]) -> np.ndarray:
    return np.fromiter((bool(c.strip(WHITE)) for c in chunks), bool, len(chunks))


def ngrams(words: list[str], low: int, high: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ``<word>`` with ``low`` to ``high`` characters, and the word of each.

    A word shorter than ``low`` with its two marks has itself as its only n-gram.
    """
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    size = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    ends = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    room = ends[owner] - np.arange(len(code)) if len(code) else np.zeros(0, np.int64)
    ids, of = [], []
    value = np.zeros(len(code), np.uint64)
    place = np.arange(len(code))
    for n in range(1, high + 1):
        inside = room[place] >= n
        place, value = place[inside], value[inside]
        value = mixed(value * _ODD + code[place + n - 1] + np.uint64(n))
        wanted = slice(None)
        if n < low:
            first = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            wanted = (size[owner[place]] == n) & (place == first[owner[place]])
        ids.append((value[wanted] % np.uint64(buckets)).astype(np.int64))
        of.append(owner[place[wanted]])
    return np.concatenate(ids), np.concatenate(of)


def mean_over_ngrams(words: list[str], low: int, high: int, tables: np.ndarray) -> np.ndarray:
    """For each word the means of the entries of its n-grams in each of the tables.

    Words are worked on in slices: their n-grams take much more room than they do.
    """
    out = np.zeros((len(words), len(tables)))
    for a in range(0, len(words), SLICE):
        part = words[a : a + SLICE]
        ids, of = ngrams(part, low, high, tables.shape[1])
        n = np.bincount(of, minlength=len(part)).clip(1)
        for i, table in enumerate(tables):
            out[a : a + SLICE, i] = np.bincount(of, table[ids], len(part)) / n
    return out
