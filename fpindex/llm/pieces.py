"""SentencePiece encoding and decoding with a unigram model.

The pieces of a model file and their log scores form a double-array trie over
UTF-8 bytes. A text is cut where no piece can cross (a word and the space
after it); each distinct part is segmented once by Viterbi: the path of
pieces with the largest sum of scores. Characters that no piece covers become
byte pieces. Spaces become the marker U+2581 and one marker is put before each
text; decoding reverses both. A marker that is itself part of a text goes
through its bytes, so that decoding always returns the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from fpindex.llm.bpe import runs
from fpindex.llm.texts import BATCH_BYTES, chunks_of, flat, small_batches
from fpindex.llm.workers import trim

MARKER = "▁".encode()
#: Stand-ins for the bytes of a marker in a text: they occur in no UTF-8 text and so in no piece.
_ESCAPED = bytes([0xF8, 0xF9, 0xFA])
#: Score below the lowest piece that a character without a piece gets.
UNKNOWN_PENALTY = 10.0
#: Bytes of parts segmented at once; a segmentation takes some hundred times their room. A longer part stands alone.
_SEGMENT_BYTES = 1 << 18


class Pieces(NamedTuple):
    """Pieces by id; ``kind`` is 0 for text, 1 for a byte, 2 for pieces that no text yields."""

    values: list[bytes]
    scores: np.ndarray
    kind: np.ndarray


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(model: bytes) -> Pieces:
    """Pieces of a SentencePiece model file.

    Scores of a unigram model are log probabilities. Those of a merge list are
    the negative order of the merges; from the order comes a log probability
    by Zipf's law, ``-log(order + 1) - log(sum of 1 / k)``.
    """
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = p.get_piece_size()
    kind = np.array(
        [1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0 for i in range(n)]
    )
    names = [p.id_to_piece(i) for i in range(n)]
    values = [bytes([int(s[3:5], 16)]) if k == 1 else s.encode() for s, k in zip(names, kind)]
    scores = np.array([p.get_score(i) for i in range(n)], float)
    plain = np.flatnonzero(kind == 0)
    ranked = np.unique(scores[plain])
    if len(ranked) == len(plain) and np.all(ranked == np.round(ranked)):
        order = np.argsort(np.argsort(-scores[plain]))
        scores[plain] = -np.log(order + 1) - np.log(np.sum(1 / np.arange(1, len(plain) + 1)))
    return Pieces(values, scores, kind)


class Trie(NamedTuple):
    """Double array: from state ``s`` byte ``b`` leads to ``base[s] + b`` if that one's ``check`` is ``s``."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray


def build_trie(keys: dict[bytes, int]) -> Trie:
    """A double-array trie of ``keys``; ``piece`` is -1 where none ends."""
    root: dict = {}
    for key, i in keys.items():
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 1 << 16
    base, check, piece = (np.full(size, v, np.int32) for v in (0, -1, -1))
    check[0] = 0
    # nodes with as many children take their places one after another; a place is sought
    # in a window of candidates at once, and the window moves on when it holds none
    cursor = [1] * 257
    window = 1024
    waiting = [(root, 0)]
    while waiting:
        node, state = waiting.pop()
        piece[state] = node.get(-1, -1)
        children = np.array(sorted(b for b in node if b >= 0), np.int64)
        if not len(children):
            continue
        while True:
            at = cursor[len(children)]
            if at + window + 512 >= len(check):
                base, check, piece = (
                    np.concatenate([a, np.full(len(a), v, np.int32)])
                    for a, v in ((base, 0), (check, -1), (piece, -1))
                )
            free = np.ones(window, bool)
            for b in children:
                free &= check[at + b : at + b + window] < 0
            if free.any():
                break
            cursor[len(children)] += window
        at += int(np.argmax(free))
        base[state] = at
        check[at + children] = state
        waiting.extend((node[int(b)], at + int(b)) for b in children)
    return Trie(base, check, piece)


class Unigram:
    """Encoder and decoder; its attributes are plain arrays, which can be broadcast."""

    def __init__(self, pieces: Pieces) -> None:
        texts = {v: i for i, (v, k) in enumerate(zip(pieces.values, pieces.kind)) if k == 0}
        self.trie = build_trie(texts)
        self.scores = pieces.scores
        self.unknown = float(pieces.scores[pieces.kind == 0].min()) - UNKNOWN_PENALTY
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(pieces.kind == 1):
            self.byte_ids[pieces.values[i][0]] = i
        if (self.byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        self.byte_ids[list(_ESCAPED)] = self.byte_ids[list(MARKER)]
        self.is_byte = pieces.kind == 1
        out = [v.replace(MARKER, b" ") if k == 0 else v if k == 1 else b"" for v, k in zip(pieces.values, pieces.kind)]
        self.out_sizes = np.array([len(v) for v in out], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        self.out = np.frombuffer(b"".join(out), np.uint8)
        crossing = {
            v[i : i + 3]
            for v in texts
            for i in range(3, len(v) - 2)
            if v[i : i + 3] == MARKER and v[i - 3 : i] != MARKER
        }
        self.by_part = not crossing
        self.longest = max(map(len, texts))

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in ``data``: where they start and end, and their ids. None crosses ``stop``."""
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        place, state, found = starts, np.zeros(len(starts), np.int64), []
        limit = stop[starts]
        for k in range(self.longest):
            inside = starts + k < limit
            starts, state, limit = starts[inside], state[inside], limit[inside]
            after = self.trie.base[state] + data[starts + k]
            good = (after < len(self.trie.check)) & (after > 0)
            good[good] = self.trie.check[after[good]] == state[good]
            starts, state, limit = starts[good], after[good].astype(np.int64), limit[good]
            if not len(starts):
                break
            piece = self.trie.piece[state]
            ends_here = piece >= 0
            found.append((starts[ends_here], starts[ends_here] + k + 1, piece[ends_here]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        s, e, p = (np.concatenate(x) for x in zip(*found))
        return s, e, p.astype(np.int64)

    def segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all parts one after another, and the bounds of each part in them."""
        ids, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a, b in runs([len(p) for p in parts], _SEGMENT_BYTES):
            some, at = self._segment(parts[a:b])
            ids.append(some.astype(np.int32))
            sizes.append(np.diff(at))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def _segment(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of parts that are few enough to be segmented together."""
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.array([len(p) for p in parts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        stop = np.repeat(bounds[1:], sizes)
        lead = (data & 0xC0) != 0x80
        chars = np.flatnonzero(lead)
        width = np.diff(np.append(chars, len(data)))
        s, e, p = self.edges(data, stop)
        single = np.zeros(len(data), bool)
        one = e - s == width[np.searchsorted(chars, s)]
        single[s[one]] = True
        bare = chars[~single[chars]]
        s = np.concatenate([s, bare])
        e = np.concatenate([e, bare + width[~single[chars]]])
        score = np.concatenate([self.scores[p], np.full(len(bare), self.unknown)])
        p = np.concatenate([p, np.full(len(bare), -1)])
        best = np.full(len(data) + 1, -np.inf)
        came = np.zeros(len(data) + 1, np.int64)  # edge by which a position is reached
        # positions are numbered so that the start of a part is not the end of the one before
        owner = np.repeat(np.arange(len(parts)), sizes)[s] if len(s) else s
        depth = e - bounds[owner] if len(s) else e
        order = np.lexsort((s, e, depth))
        s, e, p, score, depth, owner = (x[order] for x in (s, e, p, score, depth, owner))
        cuts = np.flatnonzero(np.diff(depth)) + 1
        at_start = s == bounds[owner]
        for a, b in zip([0, *cuts], [*cuts, len(s)]):
            if a == b:
                continue
            total = score[a:b] + np.where(at_start[a:b], 0.0, best[s[a:b]])
            ends = e[a:b]
            first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
            top = np.maximum.reduceat(total, first)
            run = np.repeat(np.arange(len(first)), np.diff(np.append(first, b - a)))
            hit = np.flatnonzero(total == top[run])
            _, chosen = np.unique(run[hit], return_index=True)
            best[ends[first]] = top
            came[ends[first]] = a + hit[chosen]
        return self._paths(data, bounds, s, e, p, came)

    def _paths(self, data, bounds, s, e, p, came) -> tuple[np.ndarray, np.ndarray]:
        """Follow the best edges back from the end of every part."""
        steps = []
        owner = np.flatnonzero(bounds[1:] > bounds[:-1])
        place = bounds[1:][owner]
        turn = 0
        while len(owner):
            edge = came[place]
            steps.append((owner, np.full(len(owner), turn), edge))
            place = s[edge]
            going = place > bounds[owner]
            owner, place = owner[going], place[going]
            turn += 1
        if not steps:
            return np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        owner, turn, edge = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((-turn, owner))
        owner, edge = owner[order], edge[order]
        known = p[edge] >= 0
        n = np.where(known, 1, e[edge] - s[edge])
        begin = np.cumsum(n) - n
        offset = np.arange(n.sum()) - np.repeat(begin, n)
        of = np.repeat(edge, n)
        ids = np.where(np.repeat(known, n), p[of], self.byte_ids[data[s[of] + offset]])
        total = np.bincount(owner, n, len(bounds) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(total)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and the bounds of each text in them."""
        if self.by_part:
            chunks = chunks_of(texts, "space")
            codes, bounds, values = chunks.codes, chunks.bounds, chunks.values
        else:
            values = [(t or "").encode() for t in texts.to_pylist()]
            codes = np.flatnonzero([bool(v) for v in values])
            bounds = np.concatenate([[0], np.cumsum([bool(v) for v in values])])
        # the first part of a text carries the marker of the text
        first = np.zeros(len(codes), bool)
        first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
        leading, back = np.unique(codes[first], return_inverse=True)
        codes = codes.astype(np.int64)
        codes[first] = len(values) + back
        parts = [v.replace(MARKER, _ESCAPED).replace(b" ", MARKER) for v in values]
        parts += [MARKER + parts[i] for i in leading]
        ids, at = self.segment(parts)
        sizes = np.diff(at)[codes]
        before = np.concatenate([[0], np.cumsum(sizes)])
        index = np.repeat(at[codes] - before[:-1], sizes) + np.arange(before[-1])
        return ids[index], before[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts one after another, and the bounds of each text in them."""
        sizes = self.out_sizes[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        data = self.out[np.repeat(self.out_starts[ids] - before[:-1], sizes) + np.arange(before[-1])]
        edges = before[bounds]
        keep = np.ones(len(data), bool)
        keep[edges[:-1][edges[:-1] < edges[1:]]] = False
        return data[keep], edges - np.concatenate([[0], np.cumsum(edges[:-1] < edges[1:])])

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Sum of the log scores of each text; a byte piece counts with the penalty of a character."""
        each = np.where(self.is_byte[ids], self.unknown, self.scores[ids])
        total = np.concatenate([[0.0], np.cumsum(each)])
        return total[bounds[1:]] - total[bounds[:-1]]


def shared_model(spark: SparkSession, path: str | None = None):
    """The encoder of a model file, broadcast; it has a few MB, as vocabularies do."""
    with open(path or default_model(), "rb") as file:
        state = vars(Unigram(load_pieces(file.read())))
    return spark.sparkContext.broadcast(state | {"trie": tuple(state["trie"])})


def _coder(model) -> Callable[[], Unigram]:
    def load() -> Unigram:
        unigram = Unigram.__new__(Unigram)
        unigram.__dict__.update(model.value)
        unigram.trie = Trie(*unigram.trie)
        return unigram

    return load


def _encoding(load, text: str, round_trip: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load()
        for batch in small_batches(batches, text, BATCH_BYTES // 8):
            texts = batch.column(text)
            ids, bounds = unigram.encode(texts)
            columns = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))]
            if round_trip:
                columns.append(pa.array(_same(unigram, ids, bounds, texts), pa.bool_()))
            names = [str(i) for i in range(batch.num_columns + len(columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)
            del ids, bounds, columns
            trim()

    return run


def _same(unigram: Unigram, ids: np.ndarray, bounds: np.ndarray, texts: pa.Array) -> list[bool]:
    """Whether the pieces of each text decode to it."""
    data, offsets = flat(texts)
    back, ends = unigram.decode(ids, bounds)
    return [
        np.array_equal(back[a:b], data[x:y]) for a, b, x, y in zip(ends, ends[1:], offsets, offsets[1:])
    ]


def _added(df: DataFrame, new: list[StructField]) -> tuple[DataFrame, StructType, list[str]]:
    """Columns that stay, and the schema with the new ones behind them."""
    names = {f.name for f in new}
    kept = df.select(*[c for c in df.columns if c not in names])
    schema = StructType([*kept.schema.fields, *new])
    numbered = StructType([StructField(str(i), f.dataType) for i, f in enumerate(schema.fields)])
    return kept, numbered, schema.names


def encode(
    docs: DataFrame,
    model: str | None = None,
    text: str = "text",
    out: str = "pieces",
    round_trip: str | None = None,
) -> DataFrame:
    """``docs`` with the piece ids of ``text`` as an array column ``out``.

    ``round_trip`` names a column that tells whether decoding gives the text.
    All other columns and rows stay as they are; columns of the new names are
    replaced. A null or empty text has no pieces.
    """
    load = _coder(shared_model(docs.sparkSession, model))
    new = [StructField(out, ArrayType(IntegerType()))]
    if round_trip:
        new.append(StructField(round_trip, BooleanType()))
    kept, schema, names = _added(docs, new)
    return kept.mapInArrow(_encoding(load, text, bool(round_trip)), schema).toDF(*names)


def _decoding(load, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load()
        for batch in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(batch.column(pieces)), 0), np.int64)
            for a, b in runs(sizes.tolist(), 1 << 20):
                part = batch.slice(a, b - a)
                bounds = np.concatenate([[0], np.cumsum(sizes[a:b])])
                data, ends = unigram.decode(np.asarray(part.column(pieces).flatten(), np.int64), bounds)
                raw = data.tobytes()
                texts = pa.array([raw[x:y].decode() for x, y in zip(ends, ends[1:])], pa.string())
                names = [str(i) for i in range(part.num_columns + 1)]
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=names)

    return run


def decode(
    rows: DataFrame, model: str | None = None, pieces: str = "pieces", out: str = "text"
) -> DataFrame:
    """``rows`` with the text of the piece ids in ``pieces`` as a column ``out``; null gives an empty text."""
    load = _coder(shared_model(rows.sparkSession, model))
    kept, schema, names = _added(rows, [StructField(out, StringType())])
    return kept.mapInArrow(_decoding(load, pieces), schema).toDF(*names)


def _summary(load):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = load()
        for batch in small_batches(batches, "text", BATCH_BYTES // 4):
            texts = batch.column("text")
            ids, bounds = unigram.encode(texts)
            raw = np.ascontiguousarray(ids, "<u4").tobytes()
            same = _same(unigram, ids, bounds, texts)
            byte_ids = np.concatenate([[0], np.cumsum(unigram.is_byte[ids])])[bounds]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.array(np.diff(byte_ids), pa.int64()),
                    pa.array([zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(bounds, bounds[1:])], pa.int64()),
                    pa.array(unigram.score(ids, bounds)),
                    pa.array(same, pa.bool_()),
                ],
                names=["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "score", "round_trip"],
            )
            del ids, bounds, raw, byte_ids
            trim()

    return run


def piece_summary(
    docs: DataFrame, model: str | None = None, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, score, round_trip`` of each row.

    ``round_trip`` tells whether decoding the pieces gives the text again. A
    null or empty text has no pieces and score 0. Repeated rows give repeated rows.
    """
    load = _coder(shared_model(docs.sparkSession, model))
    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _summary(load),
        f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, score double, round_trip boolean",
    )
