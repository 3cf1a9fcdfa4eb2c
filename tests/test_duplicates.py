import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fpindex.operators import duplicates as dups
from fpindex.operators import lookup
from fpindex.operators.joins import hot_join, join_groups, spread_join, top_per_key
from fpindex.operators.paths import files_by_path, resolve_paths, users_in_scope
from fpindex.plans.api import FingerprintIndex
from fpindex.sources.reports import duplicates_to_json, duplicates_to_lines

INDEX = "file_id long, algo string, hash string"
FILES = "fileid long, storage long, path string, name string, size long, mtime long, checksum string"


def files_of(spark, *rows):
    return spark.createDataFrame(
        [(i, s, p, p.rsplit("/", 1)[-1], 1, 100, None) for i, s, p in rows], FILES
    )


@pytest.fixture
def store(spark):
    files = files_of(
        spark,
        (42, 1, "files/Documents/report.pdf"),
        (108, 1, "files/Photos/vacation.jpg"),
        (256, 2, "files/copy.pdf"),
        (300, 2, ""),
        (999, 99999, "files/inaccessible.dat"),
    )
    storages = spark.createDataFrame(
        [(1, "home::admin"), (2, "local::/mnt/data/user1")], "numeric_id long, id string"
    )
    index = spark.createDataFrame(
        [
            (42, "sha1", "abc123"),
            (108, "sha1", "abc123"),
            (256, "sha1", "abc123"),
            (999, "sha1", "abc123"),
            (42, "sha256", "a" * 63 + "1"),
            (108, "sha256", "a" * 63 + "1"),
            (256, "sha256", "a" * 63 + "2"),
            (300, "md5", "only"),
        ],
        INDEX,
    )
    state = spark.createDataFrame(
        [(42, 0, None), (108, 1700000000, "auto")],
        "file_id long, updated_at long, pending_mode string",
    )
    return FingerprintIndex(files, storages, index, state)


def test_groups_and_collisions(store, rows):
    assert rows(store.duplicate_groups()) == [
        ("sha1", "abc123", 4, 42, 999),
        ("sha256", "a" * 63 + "1", 2, 42, 108),
    ]
    assert rows(store.duplicate_groups("SHA256 ")) == [("sha256", "a" * 63 + "1", 2, 42, 108)]
    assert rows(store.duplicate_groups(min_count=5)) == []
    assert rows(dups.prefix_collisions(store.index)) == [("sha256", "a" * 63, 2, 3)]


def test_unresolved_files_are_dropped_but_counted_in_the_total(store, rows):
    found = store.duplicates_with_paths(algo="sha1")
    assert rows(found.select("fileid", "file_count", "total_count", "owner")) == [
        (108, 3, 4, "admin"),
        (256, 3, 4, "user1"),
        (42, 3, 4, "admin"),
    ]
    assert rows(store.duplicates_with_paths(user="admin").select("algo", "fileid", "file_count")) == [
        ("sha1", 108, 2),
        ("sha1", 42, 2),
        ("sha256", 108, 2),
        ("sha256", 42, 2),
    ]
    # a local storage is nobody's home
    assert rows(store.duplicates_with_paths(user="user1")) == []


def test_pages(store):
    page = store.find_duplicates(limit=1).collect()
    assert [(r["algo"], r["file_count"], r["total_groups"], r["has_more"]) for r in page] == [
        ("sha1", 3, 2, True)
    ]
    page = store.find_duplicates(limit=1, offset=1).collect()
    assert [(r["algo"], r["total_groups"], r["has_more"]) for r in page] == [("sha256", 2, False)]
    groups = store.duplicate_groups()
    page = dups.page(groups, 1, after=(4, "sha1", "abc123")).collect()
    assert [(r["algo"], r["total_groups"], r["has_more"]) for r in page] == [("sha256", 2, False)]


def test_lookup(store, rows):
    assert rows(store.find_by_hash(" ABC123 ").select("fileid", "algo", "name")) == [
        (108, "sha1", "vacation.jpg"),
        (256, "sha1", "copy.pdf"),
        (42, "sha1", "report.pdf"),
    ]
    first = store.find_by_hash("abc123", limit=1).collect()
    assert len(first) == 1 and first[0]["has_more"]
    every = store.find_by_hash("abc123", limit=None).collect()
    assert len(every) == 3 and not any(r["has_more"] for r in every)
    with pytest.raises(ValueError):
        store.find_by_hash("abc123", limit=0)
    assert store.find_by_hash("abc123", algo="md5").count() == 0
    assert rows(store.find_by_hash("abc123", user="admin").select("fileid")) == [(108,), (42,)]
    with pytest.raises(ValueError):
        store.find_by_hash("  ")
    # hashes that only share a prefix are not the same
    assert store.find_by_hash("a" * 63 + "3").count() == 0


def test_batch_lookup_and_search(spark, store, rows):
    probes = spark.createDataFrame(
        [("ABC123", None), ("abc123", "md5"), ("a" * 63 + "2", "SHA256"), ("only", "sha1"), (None, None)],
        "hash string, algo string",
    )
    assert rows(store.find_by_hashes(probes).select("fileid", "algo")) == [
        (108, "sha1"),
        (256, "sha1"),
        (256, "sha256"),
        (42, "sha1"),
    ]
    terms = spark.createDataFrame(
        [("sha256:" + "A" * 63 + "1",), ("not-a-hash",), ("md5:" + "a" * 63 + "2",)], "term string"
    )
    assert rows(store.search(terms).select("fileid")) == [(108,), (42,)]
    many = lookup.find_by_hashes(store.index, store.files, store.storages, probes)
    assert rows(many) == rows(store.find_by_hashes(probes))


def test_listings(spark, store, rows):
    assert rows(store.hashes_of([42, 7]).filter("algo = 'sha1'")) == [
        (42, "sha1", "abc123", "1970-01-01T00:00:00+00:00")
    ]
    assert rows(store.hashes_of([256]).select("algo", "updated_at")) == [("sha1", None), ("sha256", None)]
    assert store.hashes_of([256], user="admin").count() == 0
    wanted = spark.createDataFrame(
        [("admin", "files/Photos/vacation.jpg"), ("user1", "files/Photos/vacation.jpg"), ("admin", "nope")],
        "owner string, path string",
    )
    assert rows(store.hashes_by_path(wanted, by_user=True).select("fileid", "algo")) == [
        (108, "sha1"),
        (108, "sha256"),
    ]
    assert rows(files_by_path(store.files, store.storages, wanted).select("fileid")) == [(108,)]
    order = store.hashes_of([42]).orderBy(lookup.canonical_order()).select("algo")
    assert [r["algo"] for r in order.collect()] == ["sha1", "sha256"]
    assert rows(lookup.hash_count_per_file(store.files, store.index)) == [
        (108, 2), (256, 2), (300, 1), (42, 2), (999, 1),
    ]


def test_same_hash(store, rows):
    assert rows(dups.same_hash_of(store.index, 42)) == [
        ("sha1", "abc123", 108),
        ("sha1", "abc123", 256),
        ("sha1", "abc123", 999),
        ("sha256", "a" * 63 + "1", 108),
    ]
    assert rows(store.same_hash([42]).select("algo", "hash_value", "file_id")) == rows(
        dups.same_hash_of(store.index, 42)
    )
    both = rows(store.same_hash([42, 256]).select("algo", "file_id"))
    assert both == [("sha1", 108), ("sha1", 256), ("sha1", 42), ("sha1", 999), ("sha256", 108)]
    assert store.same_hash([300]).count() == 0


def test_same_hash_for_few_and_many_ids(spark, rows):
    index = skewed_index(spark, 400)
    for condition in ("file_id % 7 = 0", "file_id = 3", "true"):
        ids = index.filter(condition)
        few = dups.same_hash(index, ids)
        many = dups.same_hash(index, ids, hot_rows=20)
        assert rows(few) == rows(many) and few.count()


def test_reports(store):
    members = store.duplicates_with_paths(algo="sha1")
    (row,) = duplicates_to_json(members).collect()
    group = json.loads(row["json"])
    assert group["file_count"] == 3 and "part" not in group
    assert [f["fileid"] for f in group["files"]] == [42, 108, 256]
    lines = [r["line"] for r in duplicates_to_lines(members).orderBy("fileid").collect()]
    assert lines[0] == "SHA1 / abc123 (3 files)"
    assert lines[1] == "  [42] (admin) files/Documents/report.pdf"


def test_large_groups_are_written_in_parts(spark):
    members = spark.range(1000).select(
        F.lit("sha1").alias("algo"), F.lit("h").alias("hash_value"),
        F.lit(1000).cast("long").alias("file_count"), F.col("id").alias("file_id"),
    )
    parts = dups.nest_members(members, part_files=100).collect()
    assert len(parts) == 10
    assert max(len(r["files"]) for r in parts) < 200
    assert sorted(f["file_id"] for r in parts for f in r["files"]) == list(range(1000))
    objects = [json.loads(r["json"]) for r in duplicates_to_json(members, part_files=100).collect()]
    assert sum(len(o["files"]) for o in objects) == 1000 if "files" in objects[0] else True
    assert sorted(o["part"] for o in objects) == list(range(10))


def skewed_index(spark, n=3000):
    """A third of all files have the same content."""
    return spark.range(n).select(
        F.col("id").alias("file_id"),
        F.lit("sha1").alias("algo"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("h"), (F.col("id") / 4).cast("int"))).alias("hash"),
    )


def test_hot_groups_are_whole_and_split(spark):
    index = skewed_index(spark)
    expected = defaultdict(set)
    for r in index.collect():
        expected[r["hash"]].add(r["file_id"])
    expected = {h: ids for h, ids in expected.items() if len(ids) > 1}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        members = dups.duplicate_members(index, hot_rows=100)
        found = defaultdict(set)
        for r in members.collect():
            assert r["file_count"] == len(expected[r["hash_value"]])
            found[r["hash_value"]].add(r["file_id"])
        assert found == expected
        # the rows of the hot hash are spread over all partitions of the join
        homes = members.filter("hash_value = 'hot'").select(F.spark_partition_id().alias("p"))
        assert homes.distinct().count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_spread_join_types(spark, rows):
    big = skewed_index(spark, 300)
    small = spark.createDataFrame([("hot", 1), ("h1", 2), ("none", 3)], "hash string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(small, "hash", how)
        spread = spread_join(big, small, "hash", "file_id", how).select(*plain.columns)
        assert rows(plain) == rows(spread)


def test_hot_join_equals_a_plain_join(spark, rows):
    big = skewed_index(spark, 600)
    other = big.select("hash").distinct().filter("hash <> 'h7'").withColumn("v", F.length("hash"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = big.join(other, "hash", how)
        for hot_rows in (1, 30, 10**6):
            assert rows(hot_join(big, other, "hash", "file_id", how, hot_rows).select(*plain.columns)) == rows(plain)


def test_join_groups_equals_a_plain_join(spark, rows):
    index = skewed_index(spark, 600).withColumnRenamed("hash", "hash_value")
    groups = index.groupBy("algo", "hash_value").agg(F.count("*").alias("n")).filter("n > 1")
    for hot_rows in (1, 7, 10**6):
        joined = join_groups(index, groups, ["algo", "hash_value"], "n", "file_id", hot_rows)
        plain = index.join(groups, ["algo", "hash_value"]).select(*joined.columns)
        assert rows(joined) == rows(plain)


def test_top_per_key(spark):
    df = skewed_index(spark, 900)
    top = top_per_key(df, ["hash"], [F.asc("file_id")], 5, spread_by="file_id")
    got = sorted(r["file_id"] for r in top.filter("hash = 'hot'").collect())
    assert got == [0, 3, 6, 9, 12]


def test_scopes(store, rows):
    assert rows(users_in_scope(store.storages)) == [("admin",), ("user1",)]
    assert rows(users_in_scope(store.storages, "nobody")) == []
    assert resolve_paths(store.files, store.storages).count() == 4
