"""Token counts of the sections of documents, from one encoding of the whole text.

Sections are spans of characters of a document. The whole text is encoded
once; the spans of its tokens are joined with those of the sections. A token
that crosses a border is given to a section by a stated rule:

* ``first``: the section of its first byte,
* ``most``: the section with most of its bytes, the first of equals,
* ``split``: every section it touches, in proportion to the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fpindex.llm.bpe import encoder, shared_tokenizer
from fpindex.llm.texts import BATCH_BYTES, flat, segment_ids, small_batches

RULES = ("first", "most", "split")
SPANS = "array<struct<start:int,end:int>>"


def line_sections(text: Column) -> Column:
    """The lines of a text as sections; each ends behind its line feed."""

    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        data, offsets = flat(texts)
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        line_ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets[1:]]))
        line_ends = line_ends[line_ends > 0]
        begins = np.concatenate([[0], line_ends[:-1]]) if len(line_ends) else line_ends
        owner = np.searchsorted(offsets, begins, "right") - 1
        base = chars[offsets[:-1]][owner]
        parts = [pa.array((chars[x] - base).astype(np.int32)) for x in (begins, line_ends)]
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        return pa.ListArray.from_arrays(
            bounds.astype(np.int32), pa.StructArray.from_arrays(parts, names=["start", "end"])
        )

    return spans(text)


def with_fields(df: DataFrame, fields: Sequence[str], text: str = "text", sections: str = "sections") -> DataFrame:
    """Join fields with line feeds into one text, with one section per field; null is empty."""
    values = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    spans, at = [], F.lit(0)
    for value in values:
        end = at + F.char_length(value)
        spans.append(F.struct(at.cast("int").alias("start"), end.cast("int").alias("end")))
        at = end + 1
    return df.withColumns({text: F.concat_ws("\n", *values), sections: F.array(*spans)})


def attribute(
    ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str
) -> np.ndarray:
    """Tokens per section; the last entry counts what lies in no section.

    ``ends`` are the ascending ends of the tokens, which follow one another
    from 0; sections are ascending and do not overlap.
    """
    n = len(starts)
    counts = np.zeros(n + 1)
    begins = np.concatenate([[0], ends[:-1]])
    # borders alternate: inside section k between edge 2k and 2k + 1
    edges = np.empty(2 * n, np.int64)
    edges[0::2], edges[1::2] = starts, stops
    low = np.searchsorted(edges, begins, "right")
    high = np.searchsorted(edges, ends, "left")
    region = lambda k: np.where(k % 2 == 1, k // 2, n)
    whole = low >= high if rule != "first" else np.ones(len(ends), bool)
    np.add.at(counts, region(low[whole]), 1)
    for i in np.flatnonzero(~whole):
        cuts = np.concatenate([[begins[i]], edges[low[i] : high[i]], [ends[i]]])
        share = np.zeros(n + 1)
        np.add.at(share, region(np.arange(low[i], high[i] + 1)), np.diff(cuts))
        if rule == "split":
            counts += share / share.sum()
        else:
            counts[np.argmax(share)] += 1
    return counts


def _counting(load, rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load()
        for batch in small_batches(batches, "text", BATCH_BYTES // 4):
            data, offsets = flat(batch.column("text"))
            ids, bounds = bpe.encode(batch.column("text"))
            ends = np.cumsum(bpe.widths[ids])
            lists = batch.column("sections")
            char_at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            spans = lists.flatten()
            sizes = np.diff(np.asarray(lists.offsets)) * np.asarray(lists.is_valid())
            section_bounds = np.concatenate([[0], np.cumsum(sizes)])
            owner = segment_ids(section_bounds)
            first_char = np.searchsorted(char_at, offsets[:-1])
            place = [
                np.minimum(
                    char_at[np.minimum(first_char[owner] + np.asarray(spans.field(f)), len(char_at) - 1)],
                    offsets[1:][owner],
                )
                if len(spans)
                else np.zeros(0, np.int64)
                for f in ("start", "end")
            ]
            counts, outside = _all_counts(ends, bounds, offsets, section_bounds, *place, rule)
            number = np.arange(len(owner)) - section_bounds[:-1][owner]
            rest = np.flatnonzero(outside > 0)
            row = np.concatenate([owner, rest])
            null = np.concatenate([np.zeros(len(owner), bool), np.ones(len(rest), bool)])
            both = lambda a, kind: pa.array(np.concatenate([a, np.zeros(len(rest), a.dtype)]), kind, mask=null)
            spanned = [np.asarray(spans.field(f)) if len(spans) else np.zeros(0, np.int32) for f in ("start", "end")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    both(number, pa.int64()),
                    both(spanned[0], pa.int64()),
                    both(spanned[1], pa.int64()),
                    pa.array(np.concatenate([counts, outside[rest]])),
                ],
                names=["doc_id", "section", "start", "end", "n_tokens"],
            )

    return run


def _all_counts(ends, bounds, offsets, section_bounds, starts, stops, rule):
    """Counts of all sections of a batch, and what each text has outside of them.

    Sections of one text after another are ascending over the whole batch, and
    no token crosses from text to text, so one call serves them all. Texts
    whose sections overlap or are out of order are refused.
    """
    if np.any(stops < starts) or np.any(starts[1:] < stops[:-1]):
        raise ValueError("sections must be ascending and must not overlap")
    counts = attribute(ends, starts, stops, rule)[:-1]
    total = np.diff(bounds).astype(float)
    inside = np.concatenate([[0.0], np.cumsum(counts)])[section_bounds]
    outside = total - np.diff(inside)
    outside[np.abs(outside) < 1e-6] = 0
    return counts, outside


def token_counts(
    docs: DataFrame,
    sections: str = "sections",
    rule: str = "most",
    tokenizer: str | None = None,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, section, start, end, n_tokens``: one row per section of each row.

    ``sections`` names a column of ascending, non-overlapping character spans;
    null is none. Sections are numbered from 0. A row with null section counts
    tokens outside of all sections, if there are any. An empty section has no
    tokens; a null or empty text has none either. The counts of a text add up
    to the tokens of its whole encoding. Repeated rows give repeated rows;
    other columns play no part.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule: {rule}")
    load = encoder(shared_tokenizer(docs.sparkSession, tokenizer))
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(
        F.col(id).alias("doc_id"), F.col(text).alias("text"), F.col(sections).alias("sections")
    )
    return rows.mapInArrow(
        _counting(load, rule),
        f"doc_id {kind}, section long, start long, end long, n_tokens double",
    )
