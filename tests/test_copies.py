import random

import pytest
from pyspark.sql import functions as F

from fpindex.operators.copies import copies_in_order, last_before

COPIES = "source_file_id long, file_id long, ts long, event_id long"


def plain(checksums, copies):
    """The copies one after another."""
    now, changed = dict(checksums), {}
    for source, target, _, _ in sorted(copies, key=lambda c: (c[2], c[3])):
        if now.get(source) and source != target:
            now[target] = changed[target] = now[source]
    return {i: c for i, c in changed.items() if i in checksums}


@pytest.fixture(params=["false", "true"])
def ranges(request, spark):
    """With small ranges and with merged ones."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, "true")


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_equal_a_loop_over_them(spark, ranges, seed):
    rng = random.Random(seed)
    n = 30
    checksums = {i: f"SHA1:{i}" if rng.random() < 0.4 else rng.choice([None, ""]) for i in range(n)}
    copies = [
        # one template is the source of a third, and files 30 to 33 are in no inventory
        (0 if rng.random() < 0.3 else rng.randrange(n + 4), rng.randrange(n + 4), rng.randrange(40), e)
        for e in range(150)
    ]
    files = spark.createDataFrame(list(checksums.items()), "fileid long, checksum string")
    rows = [*copies, (None, 1, 1, 900), (1, None, 1, 901), (1, 2, None, 902), (3, 3, 50, 903)]
    found = copies_in_order(files, spark.createDataFrame(rows, COPIES).repartition(5))
    assert {r.file_id: r.checksum for r in found.collect()} == plain(checksums, copies)


def test_a_long_chain(spark):
    n = 70
    files = spark.createDataFrame([(i, "MD5:x" if i == 0 else None) for i in range(n)], "fileid long, checksum string")
    chain = [(i, i + 1, i, i) for i in range(n - 1)]
    done = copies_in_order(files.withColumn("checksum", F.lit("MD5:x")), spark.createDataFrame(chain, COPIES))
    assert done.count() == n - 1
    backwards = spark.createDataFrame([(i, i + 1, -i, i) for i in range(n - 1)], COPIES)
    assert [tuple(r) for r in copies_in_order(files, backwards).collect()] == [(1, "MD5:x")]
    assert copies_in_order(files, backwards.filter("false")).count() == 0


def test_last_values_go_over_borders(spark, ranges):
    rng = random.Random(5)
    rows = [(0 if i < 300 else rng.randrange(20), i, i if rng.random() < 0.05 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(6)
    got = {(r.k, r.o): r.before for r in last_before(df, "k", "o", "v", "before").collect()}
    last = {}
    for k, o, v in sorted(rows):
        assert got[k, o] == last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert len(got) == 500
