import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_groups import brute, plain_leaks

import corpus_pipeline as C
from fpindex.llm import pieces, toxicity

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name,stage", C.STAGES)
def test_stages_take_hard_rows_and_no_rows(spark, hard_docs, no_docs, name, stage):
    out = stage(spark, hard_docs, SF)
    rows = out.collect()
    kept = set(hard_docs.columns)
    assert kept <= set(out.columns) if name == "pieces" else out.columns == hard_docs.columns
    assert stage(spark, no_docs, SF).count() == 0
    ids = [r.doc_id for r in rows]
    if name == "near_duplicates":
        # 1, 2, 3 and a row without id are near copies; 8 and 9 say the same
        texts = {(r.doc_id, (r.text or "")[:11]) for r in rows}
        assert {1, 4, 5, 6, 7, 8, 10, 11} <= set(ids) and not {2, 3, 9} & set(ids)
        assert (8, "another tex") in texts and (8, "one two") in texts
        assert sum(i is None for i in ids) == 1
    elif name == "language":
        assert not {4, 5, 6, 11} & set(ids) and {1, 2, 3, 7, 10} <= set(ids)
    else:
        assert len(rows) == hard_docs.count()


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of the tables, and some whose fate is known: near copies, leaks and texts as toxic as labelled ones."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    rows = [r for r in docs.orderBy("doc_id").collect() if 300 < len(r.text or "") < 1500][:40]
    clean = [r for r in rows if labels.get(r.doc_id) == 0][:12]
    toxic = [r for r in docs.orderBy("doc_id").collect() if labels.get(r.doc_id) == 1 and len(r.text) < 3000]
    known = {"copy": [], "leak": [], "toxic": []}
    more = []

    def plant(kind, text, like):
        known[kind].append(900_000 + len(more))
        more.append((900_000 + len(more), text, like.lang, like.source, len(text)))

    for r in clean[:6]:
        words = r.text.split()
        plant("copy", " ".join(["other", *words[1:]]), r)
    for r, item in zip(clean[6:], items):
        words = r.text.split()
        plant("leak", " ".join([*words[:20], item, *words[20:]]), r)
    for r in toxic:
        plant("toxic", r.text, r)
    kept = [tuple(r) for r in {r.doc_id: r for r in [*rows, *toxic]}.values()]
    return spark.createDataFrame([*kept, *more], docs.schema), known


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def plain_ngrams(word):
    """Hash buckets of the n-grams of a word, one character after another."""
    marked, mask = f"<{word}>", 2**64 - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    found = []
    for at in range(len(marked)):
        value = 0
        for n in range(1, min(toxicity.HIGH, len(marked) - at) + 1):
            value = mix((value * 0x9E3779B97F4A7C15 + ord(marked[at + n - 1]) + n) & mask)
            if n >= toxicity.LOW or (at == 0 and n == len(marked)):
                found.append(value % toxicity.BUCKETS)
    return found


def plain_score(model, text):
    """The softmax of the average over words of the average over n-grams."""
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in lower.replace("\x0b", " ").replace("\x0c", " ").split(" ") for w in w.split("\n") for w in w.split("\t") for w in w.split("\r") if w]
    each = [np.mean([model.evidence[b] for b in plain_ngrams(w)]) for w in words]
    return 1 / (1 + math.exp(-(sum(each) / max(1, len(each)) + model.bias)))


def test_toxicity_stage_by_a_loop_over_words(spark, planted):
    docs, known = planted
    kept = ids(C.drop_toxic(spark, docs, SF))
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: plain_score(model, r.text) for r in docs.collect()}
    assert all(abs(s - C.TOXIC_SCORE) > 1e-9 for s in scores.values())
    assert kept == {i for i, s in scores.items() if s < C.TOXIC_SCORE}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()} & set(scores)
    assert len(known["toxic"]) > 3 and not kept & set(known["toxic"]) and len(kept & clean) >= 0.95 * len(clean)


def test_near_duplicate_stage_by_all_pairs(spark, planted):
    docs, known = planted
    kept = ids(C.drop_near_duplicates(spark, docs, SF))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    expected = {i for i, _, least in brute(rows, 5, 80) if i == least}
    assert kept == expected and not kept & set(known["copy"])


def test_decontamination_stage_by_all_windows(spark, planted):
    docs, known = planted
    kept = ids(C.drop_leaks(spark, docs, SF))
    some = [(r.doc_id, r.text.lower()) for r in docs.collect()]
    items = [(r.item_id, r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {d for (d, _), s in plain_leaks(some, items).items() if s >= 0.8}
    assert kept == {d for d, _ in some} - leaked
    assert not kept & set(known["leak"]) and len(kept) > len(some) / 2


def test_language_stage_keeps_prose_and_drops_what_has_no_letters(spark, planted):
    docs, known = planted
    odd = spark.createDataFrame([(1_000_000, "12 34 --", "en", "s", 8), (1_000_001, None, "en", "s", 0)], docs.schema)
    assert ids(C.keep_language(spark, docs.unionByName(odd), SF)) == ids(docs)


def test_pieces_stage_goes_back_to_the_texts(spark, planted):
    docs, _ = planted
    coded = C.encode_pieces(spark, docs, SF)
    back = pieces.decode(coded, pieces="pieces", out="back")
    assert back.filter(~F.col("back").eqNullSafe(F.col("text"))).count() == 0
    assert coded.count() == docs.count() and coded.filter("NOT round_trip OR n_pieces <> size(pieces)").count() == 0


def test_run(spark):
    rows = C.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = rows.select("doc_id", "round_trip").collect()
    assert all(r.round_trip for r in out) and len({r.doc_id for r in out}) == len(out)
    clean = docs.filter(F.length("text") > 50).count()
    assert len(out) > 0.7 * clean


def test_queries_of_the_package_are_registered():
    import re

    from fpindex.llm.oracle import ORACLE
    from fpindex.llm.queries import QUERIES

    assert {re.match(r"op(\d+)_", q)[1] for q in QUERIES} == {str(i) for i in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)
