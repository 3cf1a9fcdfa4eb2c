import collections
import itertools
import re

import numpy as np
import pytest

from fpindex.llm import neardup
from fpindex.llm.decontaminate import blocks, find_leaks, hashed, simhash, words_of
from fpindex.llm.graph import components
from fpindex.llm.scratch import Scratch
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n, percent):
    """Smallest id reachable for every row, by comparing all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    part = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), min(ids) if ids and sets[i] else doc_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [4, 5])
def test_components_agree_with_all_pairs(hard_docs, words):
    rows = [(r.doc_id, r.text) for r in hard_docs.collect()]
    got = neardup.near_duplicates(hard_docs, words=words).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, words, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_documents(no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0


def test_group_of_near_copies_is_whole(spark):
    """Chains of links: neighbours are similar, ends are not."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([f"c{i}" for i in range(3 * k)] + base[3 * k :])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words=4).collect()}
    assert sorted(got.items()) == [(i, c) for i, _, c in sorted(brute(rows, 4, 80))]
    assert set(got.values()) == {0}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    sets = [np.sort(pool[:1000]), np.sort(pool[250:1250]), np.sort(pool[:3])]
    bounds = np.cumsum([0] + [len(s) for s in sets])
    got = neardup.super_minhash(np.concatenate(sets), bounds, 512)
    assert abs((got[0] == got[1]).mean() - 750 / 1250) < 0.07
    alone = neardup.super_minhash(sets[2], np.array([0, 3]), 512)
    assert np.array_equal(alone[0], got[2])
    # every position is filled, by a permutation per element
    assert len(set(alone[0])) == 512


def test_component_rounds(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)]
    links = spark.createDataFrame(chain, "u long, v long").repartition(7)
    got = {r.node: r.root for r in components(links, Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}


@pytest.fixture
def leaky(spark, hard_docs):
    item = " ".join(f"q{i}" for i in range(40))
    edited = item.replace("q20", "z")
    rows = [
        (50, f"before it {item.upper()} and after"), (51, f"x {edited} y"), (52, " ".join(item.split()[:25])),
        (53, "short one"), (None, f"{item} {item}"), (54, f"a b c short one d e"),
    ]
    docs = hard_docs.select("doc_id", "text", "host", "n").unionByName(
        spark.createDataFrame([(*r, "h", "n") for r in rows], "doc_id long, text string, host string, n string")
    )
    items = spark.createDataFrame(
        [(1, item), (2, item), (3, None), (4, ""), (5, "short one"), (6, "not there " * 10)],
        "item_id long, text string",
    )
    return docs, items


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_leaks(leaky, broadcast):
    docs, items = leaky
    found = find_leaks(docs, items, broadcast_shingles=broadcast).collect()
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 3)) for r in found}
    assert got == {
        (50, 1): (2, 1.0), (50, 2): (2, 1.0), (None, 1): (0, 1.0), (None, 2): (0, 1.0),
        (53, 5): (0, 1.0), (54, 5): (3, 1.0),
    }
    assert (51, 1) not in got and len(got) == 6
    loose = find_leaks(docs, items, percent=70, broadcast_shingles=broadcast).filter("doc_id = 51").collect()
    assert {(r.item_id, r.start) for r in loose} == {(1, 1), (2, 1)}


def test_no_leaks_without_items_or_documents(leaky):
    docs, items = leaky
    assert find_leaks(docs, items.filter("false")).count() == 0
    assert find_leaks(docs.filter("false"), items).count() == 0


def test_fingerprints_and_blocks(spark):
    df = spark.createDataFrame([("a b c d e f g h",), ("a b c d e f g x",), ("",)], "t string")
    rows = df.select(
        F.col("t"), simhash(hashed(words_of(F.col("t")))).alias("p"), hashed(words_of(F.col("t"))).alias("h")
    ).withColumn("b", blocks(F.col("p"), 11)).collect()
    for r in rows:
        bits = [sum((x >> b) & 1 for x in r.h) * 2 > len(r.h) for b in range(64)]
        assert r.p & (2**64 - 1) == sum(1 << b for b in range(64) if bits[b])
        assert len(r.b) == 12 and sorted(x % 12 for x in r.b) == list(range(12))
    a, b = rows[0], rows[1]
    assert bin((a.p ^ b.p) & (2**64 - 1)).count("1") > 11 or set(a.b) & set(b.b)


def plain_leaks(docs, items, k=5):
    """Best similarity of all windows of every document with every item, by sliding over all starts."""
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        w, v = text.split(), item.split()
        count = lambda x: collections.Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1))
        for start in range(max(0, len(w) - len(v)) + 1):
            a, b = count(w[start : start + len(v)]), count(v)
            common, both = (a & b).total(), (a | b).total()
            if 100 * common >= 80 * both:
                out[d, i] = max(out.get((d, i), 0), round(common / both, 6))
    return out


def leaks_found(spark, docs, items):
    found = find_leaks(
        spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")
    ).collect()
    texts = dict(docs), dict(items)
    for r in found:
        # the start that is given is that of a window as similar as it says
        window = " ".join(texts[0][r.doc_id].split()[r.start : r.start + r.n_words])
        assert plain_leaks([("", window)], [("", texts[1][r.item_id])])["", ""] == round(r.similarity, 6)
    return {(r.doc_id, r.item_id): round(r.similarity, 6) for r in found}


def test_leaks_with_contiguous_changes(spark):
    """Items cut at an end or changed in one block, as far as the similarity allows."""
    rng = np.random.default_rng(1)
    docs, items = [], []
    for n in (22, 31, 60, 100, 200):
        for turn in range(40):
            item = [f"i{n}x{turn}x{j}" for j in range(n)]
            items.append((f"{n}.{turn}", " ".join(item)))
            for name, most in (("end", 0), ("block", 4)):
                lost = (n - 4) // 9 - most
                if lost <= 0:
                    continue
                a = n - lost if name == "end" else n // 2
                other = [f"o{x}" for x in rng.integers(0, 10**9, lost)]
                text = ["before", "it", *item[:a], *other, *item[a + lost :], "and", "after"]
                docs.append((f"{n}.{turn}.{name}", " ".join(text)))
    want = {
        pair: s
        for d in docs
        for pair, s in plain_leaks([d], [i for i in items if d[0].rpartition(".")[0] == i[0]]).items()
    }
    assert len(want) == len(docs)
    assert leaks_found(spark, docs, items) == want


def test_leaks_with_moved_parts(spark):
    """Items with swapped or rotated parts, whose best window is at no shingle's own place, and items that repeat themselves."""
    docs, items = [], []
    for n, a in ((60, 30), (60, 12), (100, 40), (100, 50)):
        item = [f"m{n}x{a}x{j}" for j in range(n)]
        items.append((f"{n}.{a}", " ".join(item)))
        around = [f"s{j}" for j in range(70)]
        docs.append((f"{n}.{a}", " ".join([*around, *item[a:], *item[:a], *around])))
    again = [f"r{j % 9}" for j in range(40)]
    items.append(("again", " ".join(again)))
    docs += [("again", " ".join(["x"] * 50 + again[3:] + again[:6] + ["x"] * 50)), ("short", " ".join(again[:37]))]
    want = plain_leaks(docs, items)
    assert len(want) == 6
    assert leaks_found(spark, docs, items) == want
