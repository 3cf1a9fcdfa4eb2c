import random

import pytest
from pyspark.sql import functions as F

from fpindex.operators import generate as gen
from fpindex.operators.duplicates import duplicate_groups, group_order, page
from fpindex.operators.lookup import find_by_hash
from fpindex.operators.pending import pending_batch
from fpindex.operators.ranked import first_rows, ranked


@pytest.fixture(scope="module")
def numbers(spark):
    # one key holds a third of the rows
    rng = random.Random(7)
    rows = [("hot" if i % 3 == 0 else rng.choice("abcdefg"), i) for i in range(2000)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "owner string, fileid long").repartition(7)


@pytest.fixture
def many_ranges(spark):
    """Small tables in several ranges, which adaptive execution would merge."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def test_slices_equal_those_of_the_full_order(numbers, many_ranges):
    order = [F.asc("owner"), F.desc("fileid")]
    want = [tuple(r) for r in numbers.orderBy(*order).collect()]
    listed = ranked(numbers, order)
    assert listed.total == 2000 and len(listed.starts) > 1
    for limit, offset in [(None, 0), (1, 0), (10, 0), (500, 700), (700, 1990), (5, 2000), (None, 1500), (5, 9999)]:
        got = [tuple(r) for r in listed.slice(limit, offset).collect()]
        assert got == want[offset : None if limit is None else offset + limit]
    assert [r.place for r in listed.slice(20, 990, rank="place").collect()] == list(range(990, 1010))
    assert [tuple(r) for r in first_rows(numbers, order, 1234).collect()] == want[:1234]


def test_no_task_gets_all_rows(spark, numbers, many_ranges):
    listed = ranked(numbers, [F.asc("owner"), F.asc("fileid")])
    sizes = [b - a for a, b in zip(listed.starts, [*listed.starts[1:], listed.total])]
    assert max(sizes) < 1000
    plan = listed.slice(1500, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "TakeOrdered" not in plan


def test_nothing_to_rank(numbers):
    listed = ranked(numbers.filter("false"), [F.asc("fileid")])
    assert listed.total == 0 and listed.slice(5).count() == 0 and listed.slice(rank="place").columns[-1] == "place"


def test_pages_walk_through_all_groups(spark):
    index = spark.createDataFrame([(i, "md5", f"h{i % 40 % 17}") for i in range(200)], "file_id long, algo string, hash string")
    groups = duplicate_groups(index)
    want = [tuple(r) for r in groups.orderBy(*group_order()).collect()]
    for k in range(0, 18, 5):
        got = page(groups, 5, k).collect()
        assert [tuple(r)[:5] for r in got] == want[k : k + 5]
        assert all(r.total_groups == 17 and r.has_more == (k + 5 < 17) for r in got)
    seen, after = [], None
    while True:
        got = page(groups, 4, after=after).collect()
        seen += [tuple(r)[:5] for r in got]
        if not got[-1].has_more:
            break
        after = (got[-1].file_count, got[-1].algo, got[-1].hash_value)
    assert seen == want
    assert [tuple(r)[:5] for r in page(groups, None, 3).collect()] == want[3:]


def test_search_pages_and_budgets(spark, numbers):
    files = numbers.withColumn("path", F.concat(F.lit("/"), "owner", F.lit("/x"), "fileid", F.lit(".pdf")))
    want = sorted(r.fileid for r in files.filter("owner = 'hot'").collect())
    seen, after = [], None
    while True:
        got = gen.glob_search_page(files, "/hot/*", 300, after).collect()
        seen += [r.fileid for r in got]
        if not got[-1].has_more:
            break
        after = got[-1].fileid
    assert seen == want
    with pytest.raises(ValueError):
        gen.glob_search_page(files, "*", 0)
    assert gen.glob_search_page(files, "nothing", 5).count() == 0
    marks = gen.mark_matching(files, "*", budget=1111).collect()
    assert [m.file_id for m in marks] == [r.fileid for r in files.orderBy("owner", "fileid").limit(1111).collect()]
    state = files.select(F.col("fileid").alias("file_id"), F.lit(0).alias("updated_at"), F.lit("auto").alias("pending_mode"))
    assert [r.file_id for r in pending_batch(state, 1500).collect()] == list(range(1500))


def test_a_lookup_knows_whether_there_are_more(spark):
    files = spark.createDataFrame([(i, 1, "files/p", f"n{i}") for i in range(5)], "fileid long, storage long, path string, name string")
    storages = spark.createDataFrame([(1, "home::u")], "numeric_id long, id string")
    index = spark.createDataFrame([(i, "md5", "h") for i in range(5)], "file_id long, algo string, hash string")
    for limit, n, more in [(2, 2, True), (5, 5, False), (9, 5, False), (None, 5, False)]:
        got = find_by_hash(index, files, storages, "H", limit=limit).collect()
        assert len(got) == n and all(r.has_more == more for r in got)
