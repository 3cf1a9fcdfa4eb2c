"""Byte-level BPE of whole texts, each distinct chunk of a batch encoded once."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from fpindex.llm.texts import WHITE, chunks_of
from fpindex.llm.workers import kept

#: Bytes of distinct chunks given to the tokenizer at once; its results are large.
_PIECE_BYTES = 1 << 18


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_tokenizer(spark: SparkSession, path: str | None = None):
    """A vocabulary file, read by the driver and broadcast; such files have a few MB."""
    with open(path or default_tokenizer(), encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def splits_at_spaces(definition: dict) -> bool:
    """Whether no token spans the border between a word and the white space after it.

    True of the byte-level pattern, which only lets one space stand *before* a
    word, if texts are neither normalised nor prefixed.
    """
    pre = definition.get("pre_tokenizer") or {}
    return (
        definition.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and not any(
            t["content"].strip() != t["content"] or not t.get("special")
            for t in definition.get("added_tokens", [])
        )
    )


class Bpe:
    """Token ids of texts, the same as those of the tokenizer itself."""

    def __init__(self, text: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(text)
        self._tokenizer.encode_special_tokens = True
        definition = json.loads(text)
        self._by_chunk = splits_at_spaces(definition)
        alphabet = _byte_alphabet()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of text that each token stands for.
        self.widths = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            inside = all(c in alphabet for c in token)
            self.widths[i] = len(token) if inside else len(token.encode())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the bounds of each text in them."""
        if not self._by_chunk:
            values = [t or "" for t in texts.to_pylist()]
            ids, sizes = self._encode_all(values)
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        chunks = chunks_of(texts, "pattern")
        ids, sizes = self._encode_chunks(chunks.values)
        begins = np.cumsum(sizes) - sizes
        each = sizes[chunks.codes]
        before = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(begins[chunks.codes] - before[:-1], each) + np.arange(before[-1])
        return ids[at], before[chunks.bounds]

    def _encode_chunks(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks; those that can follow one another are encoded as one text.

        Such a chunk is a space, ASCII characters and no white space at its
        end, so that it starts and ends with tokens wherever it stands.
        """
        easy = [v[:1] == b" " and v[-1] < 128 and v[-1] not in WHITE for v in values]
        alone = [i for i, e in enumerate(easy) if not e]
        joined = [i for i, e in enumerate(easy) if e]
        order, ids = [], [np.zeros(0, np.int32)]
        sizes = np.zeros(len(values), np.int64)
        for a, b in runs([len(values[i]) for i in joined], _PIECE_BYTES):
            run = joined[a:b]
            text = b"".join([values[i] for i in run]).decode()
            got = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
            ends = np.cumsum(self.widths[got])
            wanted = np.cumsum([len(values[i]) for i in run])
            to = np.searchsorted(ends, wanted)
            if to[-1] >= len(ends) or not np.array_equal(ends[to], wanted):
                alone.extend(run)
                continue
            sizes[run] = np.diff(np.concatenate([[-1], to]))
            order.extend(run)
            ids.append(got)
        rest, rest_sizes = self._encode_all([values[i].decode() for i in alone])
        sizes[alone] = rest_sizes
        order.extend(alone)
        ids = np.concatenate([*ids, rest])
        # back from the order of encoding to that of the values
        moved = sizes[order]
        starts = np.empty(len(values), np.int64)
        starts[order] = np.cumsum(moved) - moved
        before = np.cumsum(sizes) - sizes
        return ids[np.repeat(starts - before, sizes) + np.arange(sizes.sum())], sizes

    def _encode_all(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[np.ndarray] = [np.zeros(0, np.int32)]
        sizes = np.zeros(len(values), np.int64)
        for a, b in runs([len(v) for v in values], _PIECE_BYTES):
            for i, one in enumerate(
                self._tokenizer.encode_batch_fast(values[a:b], add_special_tokens=False), a
            ):
                found = np.array(one.ids, np.int32)
                sizes[i] = len(found)
                ids.append(found)
        return np.concatenate(ids), sizes


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive items of at most ``limit`` in all, or single larger ones."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield at, i
            at, total = i, 0
        total += size
    if at < len(sizes):
        yield at, len(sizes)


def _byte_alphabet() -> set[str]:
    """Characters that stand for single bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b) for b in plain} | {chr(256 + i) for i in range(256 - len(plain))}


def encoder(broadcast) -> Callable[[], Bpe]:
    """The tokenizer of a worker."""

    def load() -> Bpe:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text = broadcast.value
        return kept(("bpe", zlib.crc32(text.encode())), lambda: Bpe(text))

    return load


