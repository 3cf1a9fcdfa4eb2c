import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fpindex.llm import pieces as P
from fpindex.llm.bpe import Bpe, default_tokenizer
from fpindex.llm.token_counts import attribute, line_sections, token_counts, with_fields
from fpindex.llm.token_store import _encoding, read_lengths, read_tokens, token_checksums, write_tokens


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def unigram():
    with open(P.default_model(), "rb") as file:
        return P.Unigram(P.load_pieces(file.read()))


def test_chunks_give_the_ids_of_whole_texts(tokenizer, sf_docs):
    odd = ["a \n b", " 　 x  y", "   x \u0085 y", "x<|endoftext|>y", "don't, 'twas a.b!c  ", "  c", "", None]
    texts = [r.text for r in sf_docs.limit(60).collect()] + odd
    with open(default_tokenizer(), encoding="utf-8") as file:
        bpe = Bpe(file.read())
    ids, bounds = bpe.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids
        assert bpe.widths[ids[bounds[i] : bounds[i + 1]]].sum() == len((text or "").encode())


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_whole_texts_in_order(spark, tmp_path, hard_docs, tokenizer, encoding):
    path = str(tmp_path / "tokens")
    write_tokens(hard_docs, path, encoding=encoding)
    got = [tuple(r) for r in token_checksums(spark, path).orderBy("start").collect()]
    rows = hard_docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.k))
    start, want = 0, []
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    some = read_tokens(spark, path, first=5, last=7)
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,5), LessThanOrEqual(doc_id,7)]" in (
        some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    )
    assert {r.doc_id: r.tokens[-1] for r in some.collect()} == {5: 2, 6: 2, 7: 2}
    lengths = read_lengths(spark, path)
    assert "tokens:array" not in lengths._jdf.queryExecution().executedPlan().toString()
    assert lengths.count() == len(rows)


def test_no_documents_no_tokens(spark, tmp_path, no_docs):
    write_tokens(no_docs, str(tmp_path / "t"))
    assert token_checksums(spark, str(tmp_path / "t")).count() == 0


def test_attribution_rules():
    ends = np.array([2, 5, 9])  # tokens 0-2, 2-5, 5-9
    starts, stops = np.array([0, 3]), np.array([3, 7])
    assert attribute(ends, starts, stops, "first").tolist() == [2, 1, 0]
    assert attribute(ends, starts, stops, "most").tolist() == [1, 2, 0]
    assert np.allclose(attribute(ends, starts, stops, "split"), [1 + 1 / 3, 2 / 3 + 1 / 2, 1 / 2])


def test_section_counts_agree_with_offsets(hard_docs, tokenizer):
    got = {}
    for r in token_counts(hard_docs.withColumn("sections", line_sections(F.col("text"))), rule="first").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.n_tokens))
    for r in hard_docs.filter("doc_id IN (1, 6, 7, 10)").collect():
        encoding = tokenizer.encode(r.text, add_special_tokens=False)
        lines = r.text.split("\n") if not r.text.endswith("\n") else r.text[:-1].split("\n")
        edges = np.cumsum([0] + [len(line) + 1 for line in lines])
        owner = np.searchsorted(edges, [a for a, _ in encoding.offsets], "right") - 1
        assert sorted(got[r.doc_id]) == [(i, float((owner == i).sum())) for i in range(len(lines))]
    assert 4 not in got and 5 not in got


def test_fields_and_gaps(spark):
    df = spark.createDataFrame([(1, "user", "hello there"), (2, None, "")], "doc_id long, role string, body string")
    rows = token_counts(with_fields(df, ["role", "body"]), rule="split").orderBy("doc_id", "section").collect()
    assert [(r.doc_id, r.section, r.start, r.end) for r in rows] == [
        (1, None, None, None), (1, 0, 0, 4), (1, 1, 5, 16), (2, None, None, None), (2, 0, 0, 0), (2, 1, 1, 1)
    ]
    assert rows[0].n_tokens == 1 and rows[1].n_tokens == 1


def plain_viterbi(unigram, pieces, text):
    """The best segmentation by the definition, one character after another."""
    by_text = {v: i for i, (v, k) in enumerate(zip(pieces.values, pieces.kind)) if k == 0}
    data = [c.encode() for c in "▁" + text.replace(" ", "▁")] if text else []
    best = [(0.0, None, None)] + [(-np.inf, None, None)] * len(data)
    for end in range(1, len(data) + 1):
        for start in range(max(0, end - 50), end):
            piece = b"".join(data[start:end])
            score = unigram.scores[by_text[piece]] if piece in by_text else unigram.unknown if end - start == 1 else None
            if score is not None and best[start][0] + score > best[end][0]:
                best[end] = (best[start][0] + score, start, by_text.get(piece))
    ids, at = [], len(data)
    while at:
        _, start, piece = best[at]
        ids[:0] = [piece] if piece is not None else [int(unigram.byte_ids[b]) for b in data[start]]
        at = start
    return ids


def test_pieces_are_the_best_path(unigram, sf_docs):
    with open(P.default_model(), "rb") as file:
        pieces = P.load_pieces(file.read())
    texts = [r.text[:400] for r in sf_docs.limit(12).collect()] + ["", " a", "日本語 été \U0001f600\n\n x", "aaaa" * 20, "x);\r\n y"]
    ids, bounds = unigram.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain_viterbi(unigram, pieces, text), text


def test_trie_finds_all_keys_and_no_other():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, "é".encode(): 4, b"\xff": 5}
    trie = P.build_trie(keys)

    def find(word):
        state = 0
        for b in word:
            after = trie.base[state] + b
            if trie.check[after] != state or after == 0:
                return -1
            state = after
        return trie.piece[state]

    assert {k: find(k) for k in keys} == keys
    assert [find(w) for w in (b"c", b"ac", b"abcd", b"")] == [-1] * 4


def test_chunks_of_a_whole_task_are_encoded_once():
    class Seen:
        sizes = []

        def encode(self, texts):
            self.sizes.append(len(texts))
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)

    places = pa.array(range(12), pa.int64())
    texts = pa.array(["a b " * (1 << 18)] * 12)
    batch = pa.RecordBatch.from_arrays([places, places, places, texts], names=["doc_id", "text_key", "part", "text"])
    assert sum(b.num_rows for b in _encoding(Seen, 2)(iter([batch]))) == 12
    assert Seen.sizes == [12]


def test_pieces_of_many_distinct_words_take_bounded_room(unigram):
    texts = pa.array([" ".join(f"{i * 7919 % 999983:x}word{i}" for i in range(a, a + 1000)) for a in range(0, 120_000, 1000)])
    want = [unigram.encode(texts.slice(i, 1))[0].tolist() for i in range(len(texts))]
    tracemalloc.start()
    ids, bounds = unigram.encode(texts)
    room = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert room < 120e6, room


def test_pieces_round_trip(hard_docs, no_docs):
    rows = P.piece_summary(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_pieces for r in rows}[4] == 0
    again = P.decode(P.encode(hard_docs, out="p"), pieces="p", out="back")
    assert again.filter(~F.col("back").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert P.piece_summary(no_docs).count() == 0
