import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fpindex.llm.queries import QUERIES
from fpindex.llm.runs import PRIMES, differences, find_runs, occurrences, periodic_runs


def plain_runs(words):
    """All runs by comparing the words at every distance."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            if end - at + q >= max(12, 2 * q):
                found.setdefault((at, end - at + q), q)
            at = max(end, at + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def words_of(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_transforms_give_exact_sums():
    rng = np.random.default_rng(3)
    for size, width in [(2, 7), (4, 11), (8, 23), (64, 191)]:
        blocks = rng.integers(0, 1 << 20, (size, 5)).astype(np.uint64)
        windows = rng.integers(0, 1 << 20, (width, 5)).astype(np.uint64)
        windows[1 : 1 + size, 2] = blocks[:, 2]
        for p in PRIMES:
            got = differences(blocks, windows, p)
            for b in range(5):
                for k in range(width - size + 1):
                    want = sum((int(x) - int(y)) ** 2 for x, y in zip(blocks[:, b], windows[k : k + size, b]))
                    assert int(got[k, b]) == want % p
        assert (2, 1) in set(zip(*(a.tolist() for a in occurrences(blocks, windows, 1 << 20))))


def test_a_sum_that_one_prime_divides_is_no_occurrence():
    # 998244353 = 3943^2 + 31348^2: the squared differences of these blocks add up to the first prime
    blocks = np.array([[0], [0]], np.uint64)
    windows = np.array([[3943], [31348], [1]], np.uint64)
    assert differences(blocks, windows, PRIMES[0])[0, 0] == 0
    assert len(occurrences(blocks, windows, 1 << 20)[0]) == 0


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rnd = random.Random(seed)
    for _ in range(30):
        texts = []
        for _ in range(rnd.randrange(1, 5)):
            n, kinds = rnd.randrange(0, 160), rnd.choice([1, 2, 3, 40])
            x = [rnd.randrange(kinds) for _ in range(n)]
            if n and rnd.random() < 0.6:
                a = rnd.randrange(n)
                p = rnd.randrange(1, max(2, (n - a) // 2))
                x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
                for _ in range(rnd.randrange(3)):
                    x[rnd.randrange(n)] = rnd.randrange(kinds)
            texts.append(x)
        bounds = np.cumsum([0] + [len(t) for t in texts])
        got = list(zip(*(a.tolist() for a in find_runs(np.array(sum(texts, []), np.int64), bounds))))
        assert got == [(int(o) + s, n, q) for t, o in zip(texts, bounds) for s, n, q in plain_runs(t)]


def test_long_repetitions_are_one_run():
    for period in (1, 3, 100, 33_334):
        got = find_runs(np.arange(100_000) % period, np.array([0, 100_000]))
        assert [a.tolist() for a in got] == [[0], [100_000], [period]]


def test_hard_rows(hard_docs, no_docs):
    got = sorted(map(tuple, periodic_runs(hard_docs).collect()), key=str)
    want = []
    for r in hard_docs.collect():
        words = words_of(r.text)
        runs = plain_runs(words) if len(words) < 2000 else None
        if runs is None:
            long = next(g for g in got if g[1] == len(words))
            want.append((r.doc_id, len(words), long[2], plain_collapse(words, [tuple(x) for x in long[2]])))
            continue
        want.append((r.doc_id, len(words), runs, plain_collapse(words, runs)))
    assert [(a, b, [tuple(x) for x in c], d) for a, b, c, d in got] == sorted(
        [(a, b, [tuple(x) for x in c], d) for a, b, c, d in want], key=str
    )
    assert periodic_runs(no_docs).count() == 0


def test_query_agrees_with_comparing_all_words(spark, sf_docs, sf_dir):
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    rows = [r for r in sf_docs.collect() if len(r.text or "") < 6_000]
    assert len(got) == sf_docs.count() and len(rows) > 150
    for r in rows:
        words = words_of(r.text)
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        hashes = [hashlib.sha256(t.encode()).hexdigest() for t in (lines, plain_collapse(words, runs))]
        assert got[r.doc_id] == (r.doc_id, len(runs), *told, *hashes)
