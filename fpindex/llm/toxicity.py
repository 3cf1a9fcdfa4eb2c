"""Toxicity from averaged subword embeddings and a linear softmax.

A word is the mean of the vectors of its character n-grams, a text the mean of
its words. Vectors and softmax are trained together, in numpy, on a bounded
sample of labelled rows. The trained softmax is folded into the vectors, so
that scoring needs one number per n-gram bucket, and unseen spellings get the
scores of the n-grams they share with known ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.llm.subwords import has_word, mean_over_ngrams, ngrams, words_in
from fpindex.llm.texts import BATCH_BYTES, chunks_of, segment_ids, segment_sums, small_batches
from fpindex.llm.workers import trim

LOW, HIGH, BUCKETS = 3, 5, 1 << 18
#: The sample: so many rows of each label at most, of texts up to so many bytes.
SAMPLE_ROWS, SAMPLE_TEXT_BYTES = 1200, 1 << 16
SIZE, EPOCHS, RATE = 8, 100, 0.05
#: Means over hundreds of words are small; the softmax sees them this much larger.
GAIN = 100.0
#: N-grams in fewer texts of the sample have no vector of their own. One whose shares
#: of the labels differ by so many standard deviations counts half.
LEAST_TEXTS, HALF_DEVIATIONS = 2, 5.0
#: Shrinks the vectors in every step.
DECAY = 1.0


class Model(NamedTuple):
    """Evidence of each bucket for label 1, and what a text without words has."""

    evidence: np.ndarray
    bias: float


def _bags(texts: pa.Array):
    """Words of all texts: distinct word and text of each place, and n-grams of the distinct words."""
    chunks = chunks_of(texts)
    words = words_in(chunks.values)
    present = has_word(chunks.values)
    owner = segment_ids(chunks.bounds)
    keep = present[chunks.codes] if len(words) else np.zeros(0, bool)
    return words, chunks.codes[keep], owner[keep]


class _Adam:
    def __init__(self, shape) -> None:
        self.m, self.v, self.t = np.zeros(shape), np.zeros(shape), 0

    def step(self, x: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        x -= RATE * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-9)


def telling(ids: np.ndarray, of: np.ndarray, row: np.ndarray, col: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weight of each bucket from 0 to 1, by how far its shares of the labels' texts are apart.

    N-grams that tell little weigh little, or they would be learnt by heart;
    those in fewer than ``LEAST_TEXTS`` texts have 0. ``ids`` are the n-grams of
    the words ``of``; ``row`` and ``col`` are the texts and words of all pairs.
    """
    order = np.argsort(col, kind="stable")
    texts = row[order]
    n_words = int(max(col.max(initial=-1), of.max(initial=-1))) + 1
    begin = np.searchsorted(col[order], np.arange(n_words + 1))
    size = np.diff(begin)
    held = np.zeros((2, BUCKETS))
    for block in range(16):
        mine = np.flatnonzero(ids % 16 == block)
        n = size[of[mine]]
        at = np.repeat(begin[of[mine]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(ids[mine], n) * len(labels) + texts[at])
        gram, text = pairs // len(labels), pairs % len(labels)
        for label in (0, 1):
            held[label] += np.bincount(gram[labels[text] == label], minlength=BUCKETS)
    of_label = np.bincount(labels, minlength=2)[:, None].clip(1)
    share = held.sum(0) / of_label.sum()
    spread = np.sqrt(share * (1 - share) * (1 / of_label).sum()).clip(1e-12)
    z = (held[1] / of_label[1] - held[0] / of_label[0]) / spread
    return np.where(held.sum(0) >= LEAST_TEXTS, z * z / (z * z + HALF_DEVIATIONS**2), 0.0)


def train(texts: pa.Array, labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Fit vectors and softmax together; ``prior`` is the share of label 1 outside of the sample."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        # one label only: every text gets the prior
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    words, word_of_place, text_of_place = _bags(texts)
    ids, of = ngrams(words, LOW, HIGH, BUCKETS)
    pair, count = np.unique(
        text_of_place.astype(np.int64) * max(len(words), 1) + word_of_place, return_counts=True
    )
    row, col = pair // max(len(words), 1), pair % max(len(words), 1)
    share = count / np.bincount(row, count, n)[row]
    per_word = np.bincount(of, minlength=len(words)).clip(1)
    weights = telling(ids, of, row, col, labels)
    ids, of = ids[weights[ids] > 0], of[weights[ids] > 0]
    used, ids = np.unique(ids, return_inverse=True)
    told = weights[used]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (SIZE, len(used)))
    softmax, bias = rng.normal(0, 0.1, (2, SIZE)), np.zeros(2)
    steps = [_Adam(x.shape) for x in (vectors, softmax, bias)]
    target = np.stack([labels == 0, labels == 1], 1).astype(float)
    weight = (0.5 / target.mean(0))[labels.astype(int)][:, None] / n
    for _ in range(EPOCHS):
        in_word = np.stack([np.bincount(of, v[ids], len(words)) / per_word for v in vectors * told])
        in_text = np.stack([np.bincount(row, share * w[col], n) for w in in_word], 1) * GAIN
        logits = in_text @ softmax.T + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        back = (p - target) * weight
        to_text = back @ softmax * GAIN
        to_word = np.stack([np.bincount(col, share * t[row], len(words)) / per_word for t in to_text.T])
        to_vectors = np.stack([np.bincount(ids, w[of], len(used)) for w in to_word]) * told
        for step, x, grad in zip(
            steps, (vectors, softmax, bias), (to_vectors + DECAY * vectors / n, back.T @ in_text, back.sum(0))
        ):
            step.step(x, grad)
    evidence = np.zeros(BUCKETS)
    evidence[used] = (softmax[1] - softmax[0]) @ vectors * told * GAIN
    # both labels weighed the same in training
    p = min(max(prior, 1e-6), 1 - 1e-6)
    return Model(evidence, float(bias[1] - bias[0] + np.log(p / (1 - p))))


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of label 1 for each text."""
    out = []
    for batch in small_batches(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]), "t", BATCH_BYTES // 2):
        chunks = chunks_of(batch.column("t"))
        n = len(chunks.values)
        present = has_word(chunks.values)
        each = mean_over_ngrams(words_in(chunks.values), LOW, HIGH, model.evidence[None])[:, 0]
        each = np.where(present, each, 0.0)
        total = segment_sums(each[chunks.codes] if n else np.zeros(0), chunks.bounds)
        words = segment_sums(present[chunks.codes] if n else np.zeros(0), chunks.bounds)
        out.append(1 / (1 + np.exp(-np.clip(total / np.maximum(words, 1) + model.bias, -30, 30))))
        del chunks, present, each
        trim()
    return np.concatenate(out) if out else np.zeros(0)


def fold(id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % folds, F.lit(-1))


def _training(prior: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(
            [b.cast(pa.schema([("text", pa.string()), ("label", pa.int32())])) for b in batches],
            pa.schema([("text", pa.string()), ("label", pa.int32())]),
        )
        texts = table.column("text").combine_chunks() if len(table) else pa.array([], pa.string())
        model = train(texts, np.asarray(table.column("label"), np.int64), prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.evidence], pa.list_(pa.float64())), pa.array([model.bias], pa.float64())], names=["evidence", "bias"]
        )
        trim()

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    rows: int = SAMPLE_ROWS,
    text_bytes: int = SAMPLE_TEXT_BYTES,
    id: str = "doc_id",
    text: str = "text",
) -> Model:
    """Train on up to ``rows`` labelled rows of each label, of texts up to ``text_bytes``.

    The rows are those with the smallest hashes of their ids. Rows without
    label, text or partner do not count; of several labels of an id the
    largest counts. Both bounds together limit what the task that trains holds.
    """
    texts = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).filter(
        F.octet_length("text") <= text_bytes
    )
    known = (
        labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id IS NOT NULL AND label IN (0, 1)")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .join(texts.select("id"), "id", "left_semi")
    )
    order = [F.xxhash64("id"), "id"]
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = known.filter("label = 1").orderBy(*order).limit(rows)
    chosen = chosen.union(known.filter("label = 0").orderBy(*order).limit(rows))
    # two times ``rows`` ids at most
    sample = texts.join(F.broadcast(chosen), "id").orderBy(*order, F.xxhash64("text")).limit(2 * rows)
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    # the sample is trained on where it lies, in one task; the model alone comes back
    made = sample.select("text", "label").coalesce(1).mapInArrow(_training(prior), "evidence array<double>, bias double")
    row = made.toArrow()
    if not len(row):
        return train(pa.array([], pa.string()), np.zeros(0, np.int64), prior)
    return Model(np.asarray(row.column("evidence").combine_chunks().flatten()), row.column("bias")[0].as_py())


def score_column(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability of label 1 of a text column; null and empty texts have a score too."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scores(Model(*shared.value), texts))

    return score(F.col(text))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Labels of rows in the fold ``held_out`` are not learnt from. Scores depend
    on the text alone; a null, empty or blank text has the score of no words.
    Repeated rows give repeated rows; other columns play no part.
    """
    model = fit(docs, labels.filter(fold(F.col(id), folds) != held_out), id=id, text=text)
    return docs.select(
        F.col(id).alias("doc_id"),
        (fold(F.col(id), folds) == held_out).alias("held_out"),
        score_column(docs, model, text).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
