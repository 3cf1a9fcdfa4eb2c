"""Languages of texts and of the spans within them.

The script of a word narrows its candidates to the languages written in it. A
word's score for a language is the log likelihood of its character n-grams.
Viterbi finds the languages of all words with the largest total, where each
change of language costs a penalty; runs of one language are the spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.llm.subwords import SLICE, mean_over_ngrams, ngrams, words_in
from fpindex.llm.texts import BATCH_BYTES, Chunks, chunks_of, segment_ids, small_batches
from fpindex.llm.workers import trim

LOW, HIGH, BUCKETS = 1, 4, 1 << 16
#: Count added to every n-gram of a language.
SMOOTHING = 0.5
#: Log likelihood that one change of language costs.
PENALTY = 12.0
#: A language is a candidate for a script that so large a part of its letters is in.
SCRIPT_SHARE = 0.02
UNDETERMINED = "und"
# Ranges of code points of scripts (Unicode blocks)
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
_EDGES = sorted((a, b, i) for i, spans in enumerate(SCRIPTS.values()) for a, b in spans)
_STARTS = np.array([a for a, _, _ in _EDGES])
_STOPS = np.array([b for _, b, _ in _EDGES])
_NUMBER = np.array([i for _, _, i in _EDGES])
OTHER = len(SCRIPTS)


def letters_and_scripts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each word, and the script of the most of them (``OTHER`` if none is listed)."""
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
    kinds = np.unique(code)
    is_letter = np.array([chr(c).isalpha() for c in kinds], bool)
    letter = is_letter[np.searchsorted(kinds, code)] if len(code) else np.zeros(0, bool)
    at = np.searchsorted(_STARTS, code, "right") - 1
    script = np.where((at >= 0) & (code <= _STOPS[at]), _NUMBER[at], OTHER)
    owner, script = owner[letter], script[letter]
    table = np.bincount(owner * (OTHER + 1) + script, minlength=len(words) * (OTHER + 1))
    table = table.reshape(len(words), OTHER + 1)
    return table.sum(1), np.where(table.sum(1) > 0, table.argmax(1), OTHER)


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # language, bucket
    written: np.ndarray  # script, language


def _counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, n-grams of its words (``feature`` from 0) and letters by script (below 0)."""
    for batch in small_batches(batches, "text", BATCH_BYTES // 2):
        chunks = chunks_of(batch.column("text"))
        words = words_in(chunks.values)
        letters, script = letters_and_scripts(words)
        useful = letters > 0
        langs = np.array(batch.column("lang").to_pylist(), object)
        owner = segment_ids(chunks.bounds)
        counts = {
            lang: np.bincount(chunks.codes[(langs == lang)[owner]], minlength=len(words)) * useful
            for lang in sorted(set(langs))
        }
        totals = {lang: np.zeros(BUCKETS) for lang in counts}
        for a in range(0, len(words), SLICE):
            ids, of = ngrams(words[a : a + SLICE], LOW, HIGH, BUCKETS)
            for lang, count in counts.items():
                totals[lang] += np.bincount(ids, count[a + of], BUCKETS)
        for lang, count in counts.items():
            grams = totals[lang]
            by_script = np.bincount(script, count * letters, OTHER + 1) if len(words) else np.zeros(OTHER + 1)
            values = np.concatenate([by_script[::-1], grams])
            features = np.arange(-OTHER - 1, BUCKETS)
            keep = values > 0
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * int(keep.sum()), pa.string()),
                    pa.array(features[keep]),
                    pa.array(values[keep].astype(np.int64)),
                ],
                names=["lang", "feature", "n"],
            )
        del chunks, words, owner, counts, totals
        trim()


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts over all rows with a language; at most ``BUCKETS`` of each language reach the driver."""
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    table = (
        rows.mapInArrow(_counting, "lang string, feature long, n long")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(table.column("lang").to_pylist(), object)
    languages = sorted(set(names))
    number = {x: i for i, x in enumerate(languages)}
    at = np.array([number[x] for x in names], np.int64)
    feature, n = np.asarray(table.column("feature")), np.asarray(table.column("n"))
    counts = np.zeros((len(languages), OTHER + 1 + BUCKETS))
    counts[at, feature + OTHER + 1] = n
    scripts, grams = counts[:, OTHER::-1], counts[:, OTHER + 1 :]
    logs = np.log(grams + SMOOTHING) - np.log(grams.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(languages, logs.astype(np.float32), (share >= SCRIPT_SHARE).T)


def word_scores(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each word under each language, and the letters of the words.

    The mean over the n-grams of a word counts once per letter. Languages not
    written in its script are ruled out, if any is; words without letters say nothing.
    """
    letters, script = letters_and_scripts(words)
    out = mean_over_ngrams(words, LOW, HIGH, model.logs) * letters[:, None]
    written = model.written[script]
    ruled_out = written.any(1, keepdims=True) & ~written & (letters > 0)[:, None]
    return np.where(ruled_out, out - 1e6, out), letters


def viterbi(scores: np.ndarray, codes: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word; texts are worked on side by side, word by word.

    Of equal totals the path without a change wins, then the first language.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    came = np.zeros((len(codes), scores.shape[1]), np.int8 if scores.shape[1] < 128 else np.int32)
    value = np.zeros((len(order), scores.shape[1]))
    own = np.arange(scores.shape[1])
    for t, n in enumerate(active):
        at = starts[:n] + t
        if t:
            v = value[:n]
            best = v.argmax(1)
            other = v[np.arange(n), best][:, None] - penalty
            change = other > v
            came[at] = np.where(change, best[:, None], own)
            value[:n] = np.maximum(v, other) + scores[codes[at]]
        else:
            value[:n] = scores[codes[at]]
    path = np.zeros(len(codes), np.int64)
    state = value.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        path[at] = state[:n]
        state[:n] = came[at, state[:n]] if t else state[:n]
    return path


def label_words(model: Model, texts: pa.Array, penalty: float = PENALTY) -> tuple[Chunks, np.ndarray, np.ndarray]:
    """Chunks of all texts, the language of each, and its letters."""
    chunks = chunks_of(texts)
    if not chunks.values:
        return chunks, np.zeros(0, np.int64), np.zeros(0, np.int64)
    scores, letters = word_scores(model, words_in(chunks.values))
    return chunks, viterbi(scores, chunks.codes, chunks.bounds, penalty), letters[chunks.codes]


def _main_language(model: Model, texts: pa.Array, penalty: float) -> tuple[list[str], np.ndarray]:
    chunks, path, letters = label_words(model, texts, penalty)
    n, k = len(chunks.bounds) - 1, len(model.languages)
    table = np.bincount(segment_ids(chunks.bounds) * k + path, letters, n * k).reshape(n, k)
    total = table.sum(1)
    best = table.argmax(1)
    names = [model.languages[b] if t > 0 else UNDETERMINED for b, t in zip(best, total)]
    return names, np.where(total > 0, table.max(1) / np.maximum(total, 1), 0.0)


def language_column(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> Column:
    """``struct<lang_pred, score>``: the language of most letters and its share of them.

    ``und`` with score 0 for a null text or one without letters, and for all
    texts if the model has learnt no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def language(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        names: list[str] = []
        parts = [np.zeros(0)]
        if not model.languages:
            names, parts = [UNDETERMINED] * len(texts), [np.zeros(len(texts))]
        else:
            for batch in small_batches(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", BATCH_BYTES // 2):
                some, share = _main_language(model, batch.column("t"), penalty)
                names += some
                parts.append(share)
                trim()
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.concatenate(parts))], names=["lang_pred", "score"]
        )

    return language(F.col(text))


def spans_column(docs: DataFrame, model: Model, text: str = "text", penalty: float = PENALTY) -> Column:
    """``array<struct<start, end, lang>>``: spans of words, the end not included, of one language each."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("array<struct<start:int,end:int,lang:string>>")
    def spans(texts: pa.Array) -> pa.Array:
        model = Model(*shared.value)
        out: list[list[dict]] = []
        for batch in small_batches(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", BATCH_BYTES // 2):
            chunks, path, letters = label_words(model, batch.column("t"), penalty)
            for a, b in zip(chunks.bounds, chunks.bounds[1:]):
                cuts = np.flatnonzero(np.diff(path[a:b])) + 1
                edges = zip([0, *cuts], [*cuts, b - a]) if letters[a:b].any() else ()
                out.append([{"start": int(x), "end": int(y), "lang": model.languages[path[a + x]]} for x, y in edges])
        return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))

    return spans(F.col(text))


def identify(
    docs: DataFrame,
    folds: int = 4,
    held_out: int = 2,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row.

    Learnt from rows with a language that are not in the fold ``held_out``; a
    row with a null id is in no fold. Predictions depend on the text alone.
    Repeated rows give repeated rows; other columns play no part.
    """
    number = F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % folds, F.lit(-1))
    model = fit(docs.filter(number != held_out), lang, text)
    found = docs.select(
        F.col(id).alias("doc_id"),
        (number == held_out).alias("held_out"),
        language_column(docs, model, text).alias("found"),
    )
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
