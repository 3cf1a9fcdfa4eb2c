import collections
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fpindex.llm import ctw, langid, topk, toxicity, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# language model


def byte_tree(texts, depth):
    """Counts of all binary decisions under all contexts, one after another."""
    counts = collections.defaultdict(lambda: [0, 0])
    for text in texts:
        data = b"\n" * 8 + b"".join(w.encode() + b" " for w in WORD.findall(lower(text))) + b"\n"
        for i in range(8, len(data)):
            node = 1
            for bit in f"{data[i]:08b}":
                for d in range(depth + 1):
                    counts[d, data[i - d : i], node][int(bit)] += 1
                node = node * 2 + int(bit)
    return counts


def plain_ctw(texts, held, depth):
    counts = byte_tree(texts, depth)
    children = collections.defaultdict(list)
    for d, context, node in counts:
        if d:
            children[d - 1, context[1:], node].append((d, context, node))
    log = {}

    def estimate(n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    for key in sorted(counts, key=lambda k: -k[0]):
        own = estimate(*counts[key])
        log[key] = own if key[0] == depth else np.logaddexp(own, sum(log[c] for c in children[key])) - math.log(2)

    def chance(context, node, d=0):
        key = (d, context[len(context) - d :], node)
        if key not in counts:
            return 0.5
        n0, n1 = counts[key]
        one = (n1 + 0.5) / (n0 + n1 + 1)
        if d == depth:
            return one
        share = math.exp(estimate(n0, n1) - math.log(2) - log[key])
        return share * one + (1 - share) * chance(context, node, d + 1)

    out = []
    for text in held:
        data = b"\n" * 8 + b"".join(w.encode() + b" " for w in WORD.findall(lower(text))) + b"\n"
        total = 0.0
        for i in range(8, len(data)):
            node = 1
            for bit in f"{data[i]:08b}":
                p = chance(data[i - depth : i], node)
                total += math.log10(p if bit == "1" else 1 - p)
                node = node * 2 + int(bit)
        out.append(total)
    return out


@pytest.mark.parametrize("part_entries", [10**6, 300])
def test_scores_agree_with_a_plain_tree(spark, part_entries):
    texts = ["The cat sat", "the cat ran é", "a dog", None, "The  dog\nsat", "unseen zebra", "the cat", "the cat"]
    ids = [1, 2, 3, 4, 5, 6, 7, 7]
    docs = spark.createDataFrame(
        [(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, score string"
    )
    got = ctw.score_texts(docs, depth=3, part_entries=part_entries).collect()
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    train = [t for t, h in zip(texts, out) if not h]
    words = collections.Counter(w for t in train for w in WORD.findall(lower(t)))
    words["</s>"] = len(train)
    total, kinds = sum(words.values()), len(words)
    want = []
    for i, t, h, s in zip(ids, texts, out, plain_ctw(train, texts, 3)):
        tokens = WORD.findall(lower(t)) + ["</s>"]
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in tokens)
        want.append((i, h, len(tokens), sum(words[w] > 0 for w in tokens), total, round(base, 6), round(s, 6)))
    rows = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    assert sorted(rows) == sorted(want)


def test_chances_of_all_bytes_add_up_to_one():
    texts = pa.array(["some words for a small tree", "more of them"])
    data, at, _ = ctw.symbols(texts)
    grams, counts = np.unique(ctw.grams_at(data, at, 4), return_counts=True)
    levels = ctw.tree(grams, counts.astype(float), 3)
    top = levels[-1]
    keys, of = np.unique(top.keys & np.uint64(0xFFFF), return_inverse=True)
    first = ctw.Top(keys, *(np.bincount(of, w) for w in (top.n0, top.n1, top.log)))
    node = (levels[0].keys & np.uint64(255)).astype(int)
    last = ((levels[0].keys >> np.uint64(8)) & np.uint64(255)).astype(int)
    p = first.add[last, node] + first.part[last, node] * ctw.chances(levels)[0]
    assert ((p > 0) & (p < 1)).all()


def test_unseen_bits_under_nodes_of_one_kind(spark):
    """A node with 1e8 ones and no zeros, and one with zeros only: the other bit is rare but not impossible."""
    code = lambda b: int.from_bytes(b, "big")
    grams, counts = np.array([code(b"then"), code(b"xyz\x00")], np.uint64), [10**8, 10**8]
    table = {"kind": ["gram"] * 2, "key": grams.view(np.int64), "n": counts, "ending": ctw.ending(grams >> np.uint64(8)).view(np.int64)}
    order = np.argsort(table["ending"])
    batch = pa.RecordBatch.from_pydict({k: pa.array(np.asarray(v)[order]) for k, v in table.items()})
    add, below = np.zeros((256, 256)), np.ones((256, 256))
    rows = [r for b in ctw._model(3, add, below)(iter([batch])) for r in b.to_pylist()]
    entries = spark.createDataFrame([tuple(r.values()) for r in rows], "depth int, key long, value double, ending long")
    state = {"depth": 3, "n_parts": 1, "part": 0, "add": add, "below": below, "ends": 1, "total": 1.0}
    for d in (0, 2, 3):
        chosen = entries.filter(f"depth = {d}")
        state[d] = ctw._collected(chosen, "ending", 1, 0, np.float32 if d else np.float64)
    state["words"] = {"key": np.zeros(0, np.uint64), "value": np.zeros(0, np.int64)}
    part = ctw.Part(state)
    # in turn: six bits at unseen nodes after a zero where only ones were, and one bit other than all others
    got = part.logs(np.array([code(b"the\x0e"), code(b"theo"), code(b"xyz\x01")], np.uint64))
    rare = math.log10(0.5 / 1e8)
    assert np.allclose(got, [rare + 6 * math.log10(0.5), rare, rare], atol=0.01)


def test_scoring_takes_bounded_room():
    odd = np.random.default_rng(7).permutation(np.arange(1, 400_001, dtype=np.uint64) * np.uint64(2654435761))
    keys = np.sort(odd[:100_000])
    state = {"depth": 3, "n_parts": 1, "part": 0, "ends": 1, "total": 9.0}
    state |= {"add": np.full((256, 256), 0.2), "below": np.full((256, 256), 0.5), 0: {"key": keys, "value": -1.0 / (1 + keys)}}
    empty = {"key": np.zeros(0, np.uint64), "value": np.zeros(0, np.float32)}
    part = ctw.Part(state | {2: empty, 3: empty, "words": empty})
    values, hit = part.grams.find(odd)
    assert np.array_equal(hit, np.isin(odd, keys)) and np.array_equal(values[hit], -1.0 / (1 + odd[hit]))
    assert not values[~hit].any() and not ctw.Lookup(keys[:0], keys[:0]).find(odd)[1].any()
    grams = np.concatenate([odd] * 8)
    tracemalloc.start()
    logs = part.logs(grams)
    room = tracemalloc.get_traced_memory()[1] - logs.nbytes
    tracemalloc.stop()
    assert np.array_equal(logs, np.concatenate([part.logs(odd)] * 8))
    assert room < 100e6, room


def test_hard_rows_are_scored(hard_docs, no_docs):
    rows = ctw.score_texts(hard_docs).collect()
    assert len(rows) == hard_docs.count() and all(r.score < 0 and r.bits_per_byte > 0 for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows}[4] == 1
    assert ctw.score_texts(no_docs).count() == 0


# toxicity


def test_unseen_spellings_are_caught(spark, hard_docs, no_docs):
    rng = np.random.default_rng(0)
    plain = [f"w{i}x{i * 7 % 31}" for i in range(300)]
    stems = ["grubnark", "snorvle", "blatchit"]

    def text(toxic):
        words = list(rng.choice(plain, 60))
        if toxic:
            words[5:5] = [stems[rng.integers(3)] + rng.choice(["s", "ed", "o", "ly"]) for _ in range(2)]
        return " ".join(words)

    rows = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(y), 0) for i, _, y in rows], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    model = toxicity.fit(docs, labels)
    new = toxicity.scores(model, pa.array([" ".join([*plain[:40], "grubnarkish", "snorvlend"]), " ".join(plain[:40])]))
    assert new[0] > 0.5 > new[1]
    hard = toxicity.score_toxicity(hard_docs, labels).collect()
    assert len(hard) == hard_docs.count() and all(0 <= r.score <= 1 for r in hard)
    assert toxicity.score_toxicity(no_docs, labels).count() == 0
    none = toxicity.score_toxicity(hard_docs, labels.filter("false")).collect()
    assert len(none) == hard_docs.count() and {r.predicted for r in none} == {0}


def test_rare_toxic_terms_are_learnt():
    """120 toxic terms, one in each toxic text, so that each is in under 1% of them."""
    rng = np.random.default_rng(1)
    made = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 9))) for _ in range(420)]
    toxic, plain = made[:120], made[120:]

    def text(label):
        words = list(rng.choice(plain, 60))
        return " ".join([*words[:30], *rng.choice(toxic, label), *words[30:]])

    labels = np.arange(2400) % 2
    model = toxicity.train(pa.array([text(y) for y in labels]), labels, 0.5)
    new = np.arange(400) % 2
    found = toxicity.scores(model, pa.array([text(y) for y in new])) >= 0.5
    assert found[new == 1].mean() > 0.9 and found[new == 0].mean() < 0.05


def test_labels_without_text_take_no_room_in_the_sample(spark):
    docs = spark.createDataFrame(
        [(i, ("grubnark " if i % 2 else "flower ") * 5) for i in range(20)] + [(20, None)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, rows=10)
    found = toxicity.scores(model, pa.array(["grubnark " * 5, "flower " * 5]))
    assert found[0] > 0.5 > found[1]


# languages


@pytest.fixture(scope="module")
def languages(spark):
    en = "the house is on the hill and this was where they then went with their things"
    de = "das haus steht auf dem berg und dort gingen sie dann mit ihren sachen schnell hin"
    ru = "дом стоит на горе и туда они потом пошли со своими вещами"
    rows = [(i, " ".join(np.random.default_rng(i).permutation(t.split())), lang) for i, (t, lang) in enumerate([(en, "en"), (de, "de"), (ru, "ru")] * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), en, de, ru


def test_mixed_texts_have_spans(spark, languages):
    docs, en, de, ru = languages
    model = langid.fit(docs)
    texts = spark.createDataFrame([(1, f"{en} {de} {ru}"), (2, None), (3, "12 !"), (4, "")], "doc_id long, text string")
    spans = {r[0]: r[1] for r in texts.select("doc_id", langid.spans_column(texts, model)).collect()}
    n = [len(t.split()) for t in (en, de, ru)]
    assert [s.lang for s in spans[1]] == ["en", "de", "ru"]
    assert abs(spans[1][0].end - n[0]) <= 1 and spans[1][2].start == n[0] + n[1]
    assert spans[2] == spans[3] == spans[4] == []


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    scores, codes = rng.normal(size=(6, 3)), rng.integers(0, 6, 7)
    path = langid.viterbi(scores, codes, np.array([0, 0, 5, 7]), 0.8)

    def total(states, codes):
        return sum(scores[c, s] for c, s in zip(codes, states)) - 0.8 * sum(a != b for a, b in zip(states, states[1:]))

    for a, b in ((0, 5), (5, 7)):
        every = np.stack(np.meshgrid(*[range(3)] * (b - a)), -1).reshape(-1, b - a)
        assert np.isclose(total(path[a:b], codes[a:b]), max(total(s, codes[a:b]) for s in every))


def test_languages_of_hard_rows(hard_docs, no_docs, languages):
    rows = langid.identify(hard_docs).collect()
    assert len(rows) == hard_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].lang_pred for i in (4, 5, 6, 11)] == ["und"] * 4 and by_id[10].lang_pred == "en"
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert langid.identify(no_docs).count() == 0
    held = [r for r in langid.identify(languages[0]).collect() if r.held_out]
    truth = {r.doc_id: r.lang for r in languages[0].collect()}
    assert held and all(truth[r.doc_id] == r.lang_pred for r in held)


# urls


def test_urls(spark):
    rules = [urls.parse_rule("allow", "org/"), urls.parse_rule("block", "a.org/x"), urls.parse_rule("block", "com/de/")]
    rows = [
        (1, "http://A.org/x?q"), (2, "https://sub.a.org/y#/x"), (3, "ftp://b.com/de/1"), (4, "http://b.com/en"),
        (5, None), (6, "no scheme"), (7, "http://xorg/"), (8, "http://org"), (9, "http://b.com?x/de/"), (9, "http://b.com?x/de/"),
    ] + [(100 + i, f"http://bad.com/de/{i}") for i in range(60)] + [(200, "http://bad.com/other")]
    pages = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, host string, outcome string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got[1] == ("a.org", "/x", "a.org/x", "block") and got[2] == ("sub.a.org", "/y", "org/", "allow")
    assert got[3] == ("b.com", "/de/1", "com/de/", "block") and got[4][:3] == ("b.com", "/en", None)
    assert got[5][:3] == got[6][:3] == ("", "", None) and got[7][2] is None
    assert got[8][:3] == ("org", "", None) and got[9][:3] == ("b.com", "", None)
    assert got[200] == ("bad.com", "/other", None, "block")
    # nearly all labelled pages are bad, and nothing is known of this one
    assert got[5][3] == "block"
    assert urls.judge_urls(pages, rules).count() == len(rows)
    assert urls.judge_urls(pages.filter("false"), rules).count() == 0
    assert urls.judge_urls(pages, []).filter("verdict <> 'allow'").count() == 0


def test_urls_below_suffixes_of_two_labels_agree_with_sql(spark, tmp_path):
    import duckdb

    from fpindex.llm.oracle import ORACLE
    from fpindex.llm.queries import URL_RULES

    hosts = ["a.co.uk", "x.a.co.uk", "b.co.uk", "c.org.uk", "co.uk", "uk", "d.ac.jp", "e.com", "f.e.com", "com.e", "g.com.mx", "g.net.mx", ""]
    rows = [(i, f"http://{hosts[i % len(hosts)]}/{['fr/', 'de/', 'x', 'es/'][i % 7 % 4]}{i}") for i in range(400)]
    rows += [(1000 + i, f"http://h{i % 9}.com.mx/{i}") for i in range(30)] + [(2000, "http://s.example.org/es/1"), (2001, None)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    pages = spark.read.parquet(f"{tmp_path}/pages.parquet")
    judged = urls.judge_urls(pages, URL_RULES)
    got = sorted(tuple(r) for r in judged.select("page_id", "host", "path", "rule", "verdict").collect())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(db.sql(ORACLE["op9_url_filter"]).fetchall())
    levels = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", *urls._levels(F.col("host")).values()).collect()
    assert {r[0]: r[1:] for r in levels}["x.a.co.uk"] == ("a.co.uk", "co.uk")


# top-k


def plain_top(rows, k, every):
    clean = [
        (i, [math.floor(256 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, (i, q) in enumerate(clean):
        if i % every == 0:
            found = [(-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(clean) if a != b and len(v) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(topk, "SLAB", 2)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in np.float32(centers[i % 6] + 0.2 * rng.normal(size=8))]) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]  # ties
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[1][1]), (2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8)]
    rows += [(3000, []), (3050, []), (4000, [1.5, -2.0]), (4001, [0.25, 9.0]), (5000, [3.0e18] * 8), (5050, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, block int")
    got = sorted(tuple(r) for r in topk.top_k(df, k=5, every=50).collect())
    clipped = [(q, r, v, max(-(2**63), min(2**63 - 1, s))) for q, r, v, s in plain_top(
        [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 5, 50)]
    assert [g for g in got if g[0] != 5000] == [c for c in clipped if c[0] != 5000]
    assert topk.top_k(df.filter("false")).count() == 0


def test_cover_tree_covers_and_separates():
    rng = np.random.default_rng(2)
    points = np.floor(100 * (rng.normal(size=(10, 3))[rng.integers(0, 10, 700)] + 0.1 * rng.normal(size=(700, 3))))
    waiting, leaves = [topk.cover_tree(points)], []
    while waiting:
        node = waiting.pop()
        assert (np.linalg.norm(points[node.points] - node.center, axis=1) <= node.radius + 1e-9).all()
        if node.children:
            centers = np.array([c.center for c in node.children])
            gaps = np.linalg.norm(centers[:, None] - centers[None], axis=2)[np.triu_indices(len(centers), 1)]
            assert (gaps > node.radius / 2).all() and all(c.radius <= node.radius / 2 + 1e-9 for c in node.children)
            waiting += node.children
        else:
            leaves += list(node.points)
    assert sorted(leaves) == list(range(700))
