import json

from pyspark.sql import functions as F

from fpindex.functions import codec
from fpindex.operators.duplicates import duplicate_groups
from fpindex.operators.lookup import filter_hash
from fpindex.operators.wide import wide_index
from fpindex.session import ensure_checkpoint_dir
from fpindex.sources import metadata, store

INDEX = "file_id long, algo string, hash string"
STATE = "file_id long, updated_at long, pending_mode string"
EAV = "file_id long, meta_key string, meta_value_string string, meta_value_int long"


def test_json_documents(spark, rows):
    documents = spark.createDataFrame(
        [
            (1, '{"file-checksum-sha1":{"value":"abc123","type":"string","etag":"","indexed":true,"editPermission":0}}'),
            (2, '{"file-checksum-sha1":"abc123","file-checksum-md5":["def"],"photos":{"value":1}}'),
            (3, '{"file-checksum-sha1":{"value"'),
            (4, ""),
            (5, None),
            (6, '{"file-checksum-updated_at":{"value":7,"type":"int"}}'),
        ],
        "file_id long, json string",
    )
    assert rows(metadata.import_json(documents)) == [
        (1, "sha1", "abc123"),
        (2, "md5", "def"),
        (2, "sha1", "abc123"),
    ]
    assert [r["file_id"] for r in metadata.quarantine_json(documents).collect()] == [3]
    found = metadata.extract_authoritative(F.col("json"), F.lit("file-checksum-md5"))
    assert {r["file_id"]: tuple(r["x"]) for r in documents.select("file_id", found.alias("x")).collect()} == {
        i: ("md5", "def" if i == 2 else None) for i in range(1, 7)
    }


def test_key_value_rows(spark, rows):
    sha1 = "a" * 40
    index = spark.createDataFrame([(1, "sha1", sha1), (1, "sha512", "b" * 128)], INDEX)
    state = spark.createDataFrame([(1, 9, "auto"), (2, 0, None)], STATE)
    eav = metadata.export_eav(index, state)
    assert rows(eav) == rows(
        spark.createDataFrame(
            [
                (1, "file-checksum-sha1", sha1, None),
                (1, "file-checksum-sha512", "b" * 63, None),
                (1, "file-checksum-updated_at", "pending:auto", 9),
                (2, "file-checksum-updated_at", None, 0),
            ],
            EAV,
        )
    )
    assert rows(metadata.import_eav_state(eav)) == rows(state)
    assert rows(metadata.import_eav(eav)) == [(1, "sha1", sha1)]
    assert rows(metadata.quarantine_eav(eav)) == [(1, "file-checksum-sha512", "b" * 63)]
    documents = metadata.export_json(index, state)
    assert rows(metadata.import_eav_full(eav, documents)) == rows(index)
    assert rows(metadata.import_eav(eav, documents)) == rows(index)
    assert metadata.quarantine_eav(eav, documents).count() == 0
    assert rows(metadata.import_json(documents)) == rows(index)
    assert json.loads(documents.filter("file_id = 2").first()["json"]) == {
        "file-checksum-updated_at": {"value": "0", "type": "int", "etag": "", "indexed": True, "editPermission": 0}
    }


def test_truncated_index_values_are_rechecked(spark, rows):
    full = "a" * 63 + "b"
    index = spark.createDataFrame([(1, "sha256", full)], INDEX)
    state = spark.createDataFrame([], STATE)
    eav, documents = metadata.export_eav(index, state), spark.createDataFrame(
        [(1, json.dumps({"file-checksum-sha256": {"value": full, "type": "string"}}))], "file_id long, json string"
    )
    assert rows(metadata.lookup_truncated(eav, documents, "a" * 128)) == []
    assert rows(metadata.lookup_truncated(eav, documents, full.upper(), "sha256")) == [(1, "sha256", full)]
    assert rows(metadata.lookup_truncated(eav, documents, full, "sha1")) == []


def test_packed_column(spark, rows):
    files = spark.createDataFrame(
        [(1, "SHA1:a MD5:b"), (2, "junk FOO:x SHA1:c"), (3, None)], "fileid long, checksum string"
    )
    assert rows(metadata.import_packed(files)) == [(1, "md5", "b"), (1, "sha1", "a"), (2, "sha1", "c")]
    assert rows(metadata.quarantine_packed(files)) == [(2, "junk FOO:x SHA1:c", 2)]
    index = spark.createDataFrame([(1, "sha1", "new"), (3, "md5", "m"), (3, "sha1", "s")], INDEX)
    assert rows(store.with_packed_mirror(files, index, keep_additional=True)) == [
        (1, "SHA1:new MD5:b"),
        (2, "junk FOO:x SHA1:c"),
        (3, "SHA1:s MD5:m"),
    ]
    assert rows(store.with_packed_mirror(files, index))[0] == (1, "SHA1:new")
    assert rows(metadata.export_packed(index)) == [(1, "SHA1:new"), (3, "SHA1:s MD5:m")]


def test_stored_index_is_pruned_by_hash(spark, tmp_path):
    path = str(tmp_path / "index")
    index = spark.range(2000).select(
        F.col("id").alias("file_id"), F.lit("sha1").alias("algo"), F.sha1(F.col("id").cast("string")).alias("hash")
    )
    store.write_index(index, path, partitions=4)
    read = store.read_index(spark, path)
    value = read.select("hash").first()["hash"]
    hits = filter_hash(read, value, "SHA1")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(hash,{value})" in plan
    assert hits.count() == 1 and read.count() == 2000
    # hashes of different files do not overlap
    spans = read.groupBy(F.input_file_name().alias("f")).agg(F.min("hash").alias("lo"), F.max("hash").alias("hi"))
    spans = sorted((r["lo"], r["hi"]) for r in spans.collect())
    assert len(spans) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_bucketed_index_needs_no_shuffle(spark):
    index = spark.range(100).select(
        F.col("id").alias("file_id"), F.lit("sha1").alias("algo"), F.col("id").cast("string").alias("hash")
    )
    spark.sql("DROP TABLE IF EXISTS bucketed_index")
    store.write_index_table(index, "bucketed_index", buckets=4)
    store.write_index_table(index, "index_by_hash", buckets=4, by="hash")
    try:
        groups = duplicate_groups(spark.table("index_by_hash"))
        assert "Exchange" not in groups._jdf.queryExecution().executedPlan().toString()
        wide = wide_index(spark.table("bucketed_index"))
        assert "Exchange" not in wide._jdf.queryExecution().executedPlan().toString()
        assert wide.count() == 100
    finally:
        spark.sql("DROP TABLE bucketed_index")
        spark.sql("DROP TABLE index_by_hash")


def test_checkpoints_go_where_the_session_says(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert ensure_checkpoint_dir(spark)
    if configured:
        assert configured in ensure_checkpoint_dir(spark)


def test_key_names(spark):
    row = spark.range(1).select(
        codec.hash_key(F.lit("SHA1")).alias("k"), codec.algo_from_key(F.lit("file-checksum-sha1")).alias("a")
    ).first()
    assert tuple(row) == ("file-checksum-sha1", "sha1")


def test_lookup_benchmark(spark):
    from fpindex.plans.benchmark import compare_lookup

    files = spark.createDataFrame([(1, "a", "SHA1:x"), (2, "b", None)], "fileid long, path string, checksum string")
    index = spark.createDataFrame([(1, "sha1", "x")], INDEX)
    times = compare_lookup(index, files, "absent", iterations=2)
    assert times["filecache_rows"] == 2 and times["tracked_rows"] == 1 and times["speed_up"] > 0
