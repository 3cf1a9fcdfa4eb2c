import datetime as dt

from pyspark.sql import functions as F

from fpindex.operators.attempts import ATTEMPTS, due_state, next_attempts, retry_stats, wait_after, without_attempts
from fpindex.operators.rules import Rule
from fpindex.operators.upkeep import create_store
from fpindex.schemas import FILE_EVENTS
from fpindex.sources.versions import VersionedStore
from fpindex.streaming import compact as compacting
from fpindex.streaming import fold as folding

STATE = "file_id long, updated_at long, pending_mode string"


def test_waits_double_up_to_a_bound(spark):
    waits = spark.range(1, 60).select(wait_after(F.col("id"), 10, 1000)).collect()
    assert [w[0] for w in waits] == [min(10 * 2**i, 1000) for i in range(59)]


def test_attempts_follow_outcomes(spark, rows):
    known = spark.createDataFrame([(1, 2, 500), (2, 1, 400), (3, 7, 900)], ATTEMPTS)
    outcome = spark.createDataFrame([(1, False), (2, True), (4, False)], "file_id long, success boolean")
    after = next_attempts(known, outcome, now=1000, first=60)
    assert rows(after) == [(1, 3, 1240), (3, 7, 900), (4, 1, 1060)]
    assert rows(next_attempts(after, outcome.filter("false"), 2000)) == rows(after)
    state = spark.createDataFrame([(1, 5, "auto"), (3, 6, "force"), (9, 7, "new"), (8, 8, None)], STATE)
    assert rows(due_state(state, after, 1000)) == [(1, 5, None), (3, 6, "force"), (8, 8, None), (9, 7, "new")]
    assert rows(due_state(state, after, 1240)) == rows(state)
    anew = spark.createDataFrame([(1,), (1,)], "file_id long")
    assert rows(due_state(state, without_attempts(after, anew), 0)) == [(1, 5, "auto"), (3, 6, None), (8, 8, None), (9, 7, "new")]
    assert rows(retry_stats(after, 1060)) == [(1, 1, 1, 1060), (3, 1, 0, 1240), (7, 1, 1, 900)]


def test_an_unreadable_file_is_tried_on_schedule(spark, tmp_path):
    files = spark.createDataFrame(
        [(i, 1, f"/f{i}", f"f{i}", 1, 100, None, "u") for i in (1, 2)],
        "fileid long, storage long, path string, name string, size long, mtime long, checksum string, owner string",
    )
    store = VersionedStore(spark, str(tmp_path / "store"))
    empty = spark.createDataFrame([], "file_id long, algo string, hash string")
    create_store(store, files, spark.createDataFrame([(1, 0, "missing")], STATE), empty, buckets=1)
    tried = []
    # waits of 60 and 120 seconds; at 1500 it can be read
    for turn, (now, i, readable) in enumerate([(1000, 2, False), (1030, 2, False), (1070, 2, False), (1500, 2, True)]):
        event = [(turn, dt.datetime(2024, 1, 1, turn), "metadata", i, None, f"/f{i}", "u")]
        spark.createDataFrame(event, FILE_EVENTS).write.parquet(f"{tmp_path}/in/part={turn}")
        there = [(2, bytearray(b"x"))] + ([(1, bytearray(b"y"))] if readable else [])
        compacting.start_store_drain(
            folding.event_source(spark, f"{tmp_path}/in/*"), store, [Rule("r", mode="missing")],
            spark.createDataFrame(there, "file_id long, content binary"), str(tmp_path / "out"), str(tmp_path / "cp"),
            now=lambda: now, every=2, algos=("sha1", "md5", "adler32", "crc32", "sha256", "sha512", "sha3-256", "sha3-512"),
            trigger={"availableNow": True},
        ).awaitTermination()
        waiting = compacting.current(store, str(tmp_path / "out"))["attempts"].collect()
        tried.append([(r.file_id, r.attempts, r.retry_at) for r in waiting])
    assert tried == [[(1, 1, 1060)], [(1, 1, 1060)], [(1, 2, 1190)], []]
    assert {r.file_id for r in compacting.current(store, str(tmp_path / "out"))["index"].collect()} == {1, 2}
