import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fpindex.llm.codes import assign_again, assign_all, entry_groups, net_displacements, part_sums, vector_codes


def plain_codes(rows, parts, entries, rounds, scale=256):
    """Codes by comparing every part with every entry, in whole numbers."""
    kept = [
        (i, label, [math.floor(scale * x) for x in v])
        for i, label, v in rows
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for turn in range(rounds + 1):
        found = [[nearest(x, books[p]) for p, x in enumerate(cut(v))] for _, _, v in kept]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v)[p] for (_, _, v), f in zip(kept, found) if f[p][1] == e]
                if mine:
                    books[p][e] = [sum(x[i] for x in mine) // len(mine) for i in range(width)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, label, _), e in zip(kept, errors):
        of_label[label] = of_label.get(label, 0) + e
    return [
        (i, "".join(f"{e:02x}" for _, e in f), err, of_label[label], digest)
        for (i, label, _), f, err in zip(kept, found, errors)
    ]


def taken(df):
    return sorted(map(tuple, df.drop("computed").collect()), key=str)


def test_codes_of_hard_rows(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([None, 1, 2]), [rnd.choice([-1.5, 0.0, 0.25, rnd.gauss(0, 1)]) for _ in range(8)]) for i in range(60)]
    rows += [(7, 1, rows[7][2]), (7, 1, rows[7][2]), (None, 2, rows[3][2]), (3, None, rows[5][2])]  # repeated rows and ids
    rows += [(100, 1, None), (101, 1, []), (102, 1, [None] * 8), (103, 1, [float("nan")] * 8), (104, 1, [float("inf")] + [0.0] * 7)]
    table = [(i, v, label, "x", "y", 3) for i, label, v in rows]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, code string, v string, n int").repartition(3)
    exact = [(r.vec_id, r.label, r.embedding) for r in df.collect()]
    for entries, rounds, hot in [(10, 2, 5), (256, 1, 1000), (1, 3, 1000), (16, 0, 1000)]:
        got = taken(vector_codes(df, parts=4, entries=entries, rounds=rounds, hot_rows=hot))
        assert got == sorted(plain_codes(exact, 4, entries, rounds), key=str)
    assert vector_codes(df.filter("false")).count() == 0
    assert vector_codes(df.filter("vec_id >= 100")).count() == 0
    with pytest.raises(ValueError):
        vector_codes(df, parts=3)


def spread(n, parts, width, seed=0):
    rng = np.random.default_rng(seed)
    centers = rng.integers(-400, 400, (60, parts, width))
    return centers[rng.integers(0, 60, n)] + rng.integers(-60, 60, (n, parts, width))


def test_bounds_change_nothing_and_spare_most_distances():
    x = spread(4000, 3, 4)
    history = x[:64].swapaxes(0, 1)[None]
    groups = np.stack([entry_groups(b) for b in history[0]])
    state, spared = None, []
    for turn in range(5):
        full, nearest, all_of_them = assign_all(x, history[-1], groups)
        if state is None:
            state = full
        else:
            state, least, computed = assign_again(x, history, groups, state)
            assert (state.codes == full.codes).all() and (least == nearest).all()
            spared.append(computed / all_of_them)
            # what a bound says is true of the codebooks of its round
            for p in range(3):
                for g in range(groups.max() + 1):
                    others = np.flatnonzero(groups[p] == g)
                    for i in range(0, len(x), 331):
                        then = history[state.stamps[i, p, g], p]
                        left = [((x[i, p] - then[e]) ** 2).sum() ** 0.5 for e in others if e != state.codes[i, p]]
                        assert state.bounds[i, p, g] <= min(left, default=np.inf)
        sums, counts = part_sums(x, state.codes, 64)
        moved = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], history[-1])
        history = np.concatenate([history, moved[None]])
    assert spared[0] < 0.5 and spared[-1] < 0.25


def test_net_displacement_is_at_most_the_sum_of_drifts():
    rng = np.random.default_rng(1)
    history = np.cumsum(rng.integers(-9, 9, (5, 2, 16, 4)), axis=0)
    groups = np.stack([entry_groups(b, 4) for b in history[0]])
    net = net_displacements(history, groups)
    steps = [net_displacements(history[s : s + 2], groups)[0] for s in range(4)]
    for s in range(4):
        assert (net[s] <= sum(steps[s:]) + 1e-6).all()
    assert net[0].sum() < 0.8 * sum(steps).sum()


def test_query_spares_distances(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = vector_codes(df)
    computed, n = found.agg(F.sum("computed"), F.count("*")).first()
    assert n == df.count() and computed < 0.8 * n * 3 * 16 * 64
