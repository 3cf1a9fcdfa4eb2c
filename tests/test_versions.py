import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fpindex.operators.rules import Rule
from fpindex.operators.upkeep import commit_outcome, create_store, hash_counts, kept_page
from fpindex.operators.duplicates import duplicate_groups, page
from fpindex.plans.api import FingerprintIndex
from fpindex.schemas import FILE_EVENTS
from fpindex.sources.versions import Change, Conflict, VersionedStore, bucket_of
from fpindex.streaming import compact as compacting
from fpindex.streaming import fold as folding

STATE = "file_id long, updated_at long, pending_mode string"
INDEX = "file_id long, algo string, hash string"
FILES = "fileid long, storage long, path string, name string, size long, mtime long, checksum string, owner string"
OUTCOME = (
    "file_id long, updated_at long, next_pending string, hashes map<string,string>, mode string,"
    " success boolean, error string"
)
ALGOS = ("sha1", "md5", "adler32", "crc32", "sha256", "sha512", "sha3-256", "sha3-512")


def tables(spark, n=40):
    files = [(i, 1, f"/auto/f{i}", f"f{i}", 1, 100, "MD5:old" if i % 5 == 0 else None, "u") for i in range(n)]
    state = [(i, 50, "missing" if i % 4 == 0 else None) for i in range(0, n, 2)]
    index = [(i, a, f"{a}-{i % 7}") for i in range(n) for a in ("sha1", "md5") if (i + len(a)) % 3]
    return (
        spark.createDataFrame(files, FILES),
        spark.createDataFrame(state, STATE),
        spark.createDataFrame(index, INDEX),
    )


@pytest.fixture
def store(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    create_store(store, *tables(spark), buckets=16)
    return store


def outcome_of(spark, rows):
    return spark.createDataFrame(rows, OUTCOME)


SOME = [
    (1, 900, None, {"sha1": "sha1-0", "crc32": "c"}, "missing", True, None),
    (2, 50, "auto", {"md5": "kept"}, "auto", False, "Content not readable."),
    (3, 0, None, {}, "lazy", True, None),
]


def test_a_store_gives_back_its_tables(spark, store, rows, tmp_path):
    files, state, index = tables(spark)
    assert rows(store.read("files")) == rows(files) and rows(store.read("state")) == rows(state)
    assert rows(store.read("index")) == rows(index) and rows(store.read("groups")) == rows(hash_counts(index))
    for b in (0, 7, 15):
        want = files.filter(bucket_of(["fileid"], 16) == b)
        assert rows(store.read("files", buckets=[b])) == rows(want)
    with pytest.raises(Conflict):
        create_store(store, files, state, index)
    with pytest.raises(ValueError):
        store.read("files", 9)
    empty = VersionedStore(spark, str(tmp_path / "empty"))
    create_store(empty, *[t.filter("false") for t in (files, state, index)], buckets=4)
    assert empty.read("index").count() == 0 and empty.read("index").schema == index.schema
    commit_outcome(empty, outcome_of(spark, SOME))
    assert rows(empty.read("index")) == [(1, "crc32", "c"), (1, "sha1", "sha1-0"), (2, "md5", "kept")]


def test_a_commit_makes_all_tables_current(spark, store, rows):
    commit_outcome(store, outcome_of(spark, SOME))
    new = store.read("index")
    assert {r for r in rows(new) if r[0] in (1, 2, 3)} == {(1, "crc32", "c"), (1, "sha1", "sha1-0"), (2, "md5", "kept")}
    assert rows(new.filter("file_id > 3")) == rows(tables(spark)[2].filter("file_id > 3"))
    assert {r[0]: r[1:] for r in rows(store.read("state")) if r[0] < 4} == {
        0: (50, "missing"), 1: (900, None), 2: (50, "auto"), 3: (0, None)
    }
    packed = {r.fileid: r.checksum for r in store.read("files").collect()}
    assert packed[1] == "SHA1:sha1-0 CRC32:c" and packed[2] is None and not packed[3] and packed[5] == "MD5:old"
    assert rows(store.read("groups")) == rows(hash_counts(new))
    assert rows(store.read("index", 1)) == rows(tables(spark)[2])
    old = FingerprintIndex.of_store(store, spark.createDataFrame([(1, "home::u")], "numeric_id long, id string"), version=1)
    assert rows(old.duplicate_groups()) == rows(duplicate_groups(tables(spark)[2]))


def test_a_killed_write_leaves_the_version_before(spark, store, rows, monkeypatch):
    before = rows(store.read("index"))

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(VersionedStore, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            commit_outcome(store, outcome_of(spark, SOME))
    assert store.numbers() == [1] and rows(store.read("index")) == before
    commit_outcome(store, outcome_of(spark, SOME))
    assert store.numbers() == [1, 2] and rows(store.read("index")) != before


def test_one_of_two_writers_wins(spark, store):
    base = store.version()
    commit_outcome(store, outcome_of(spark, SOME), base)
    with pytest.raises(Conflict):
        commit_outcome(store, outcome_of(spark, SOME[:1]), base)
    assert store.numbers() == [1, 2]


def test_only_touched_buckets_are_rewritten(spark, store):
    before = store.version().tables
    commit_outcome(store, outcome_of(spark, SOME))
    after = store.version().tables
    for name, n in (("state", 3), ("index", 3), ("files", 3), ("groups", 8)):
        changed = {b for b in {*before[name], *after[name]} if before[name].get(b) != after[name].get(b)}
        assert 0 < len(changed) <= n
    touched = {str(r[0]) for r in outcome_of(spark, SOME).select(bucket_of(["file_id"], 16)).collect()}
    assert {b for b in before["index"] if before["index"][b] != after["index"].get(b)} <= touched
    commit_outcome(store, outcome_of(spark, []))
    assert store.version().tables == after
    with pytest.raises(ValueError):
        ids = spark.createDataFrame([(1,)], "file_id long")
        store.commit({"state": Change(ids, lambda rows: tables(spark)[1])})


def test_old_versions_go_by_age(spark, store, rows):
    for _ in range(2):
        commit_outcome(store, outcome_of(spark, SOME))
    created = store.version().created
    assert store.vacuum(3600) == [] and store.numbers() == [1, 2, 3]
    removed = store.vacuum(3600, now=created + 7200)
    assert store.numbers() == [3] and removed
    assert rows(store.read("groups")) == rows(hash_counts(store.read("index"))) and store.read("files").count() == 40
    with pytest.raises(ValueError):
        store.read("index", 1)


@pytest.mark.parametrize("seed", [1])
def test_kept_groups_equal_grouping_again(spark, store, rows, seed):
    rng = random.Random(seed)
    for _ in range(3):
        ids = rng.sample(range(60), 15)
        commit_outcome(store, outcome_of(spark, [
            (i, 1, None, {a: f"{a}-{rng.randrange(5)}" for a in rng.sample(ALGOS, rng.randrange(4))}, "force", rng.random() < 0.8, None)
            for i in ids
        ]))
        index = store.read("index")
        assert rows(store.read("groups")) == rows(hash_counts(index))
    for options in ({"limit": 4}, {"limit": 3, "offset": 2}, {"limit": None, "algo": "SHA1", "min_count": 3}):
        rest = {k: v for k, v in options.items() if k in ("limit", "offset")}
        whole = duplicate_groups(index, options.get("algo"), options.get("min_count", 2))
        want = page(whole, **rest).select("algo", "hash_value", "file_count", "first_file_id", "last_file_id")
        assert rows(kept_page(store, **options)) == rows(want)


T0 = dt.datetime(2024, 1, 1)
RULES = [Rule(m, f"/{m}/*", mode=m) for m in ("force", "lazy", "auto")]


def write_events(spark, events, folder):
    spark.createDataFrame(events, FILE_EVENTS).coalesce(1).write.parquet(folder)


def streamed(spark, home, every, rows):
    """State, index and inventory after three runs of a stream, compacted every so many batches."""
    folder, out, store = f"{home}/in", f"{home}/out", VersionedStore(spark, f"{home}/store")
    create_store(store, *tables(spark, 12), buckets=2)
    lost = {0: set(), 1: {3}, 2: {3, 4}}  # contents that cannot be read in a run
    for turn, kinds in enumerate((["written", "metadata"], ["metadata", "copied"], ["deleted", "metadata"])):
        write_events(spark, [
            (100 * turn + i, T0 + dt.timedelta(hours=turn), kinds[i % 2], i, (i + 1) % 12, f"/auto/f{i}", "u") for i in range(0, 12 - 3 * turn)
        ], f"{folder}/part={turn}")
        content = spark.createDataFrame(
            [(i, bytearray(b"%d-%d" % (i, turn))) for i in range(12) if i not in lost[turn]], "file_id long, content binary"
        )
        compacting.start_store_drain(
            folding.event_source(spark, f"{folder}/*"), store, RULES, content, out, f"{home}/cp",
            now=lambda: 1000 * (turn + 1), every=every, trigger={"availableNow": True},
        ).awaitTermination()
        assert len(compacting.logged(spark, out, store.version())) < every
    now = compacting.current(store, out)
    return store, [rows(now[t]) for t in ("state", "index", "files")]


def test_compaction_in_mid_stream_changes_nothing(spark, tmp_path, rows):
    often, at_once = streamed(spark, tmp_path / "a", 1, rows)
    seldom, mixed = streamed(spark, tmp_path / "b", 2, rows)
    assert mixed == at_once and (often.version().number, seldom.version().number) == (4, 2)
    assert rows(often.read("groups")) == rows(hash_counts(often.read("index")))
    compacting.compact(seldom, str(tmp_path / "b" / "out"))
    assert [rows(seldom.read(t)) for t in ("state", "index", "files")] == mixed


def test_a_batch_that_a_version_has_is_not_repeated(spark, tmp_path, rows):
    store = VersionedStore(spark, str(tmp_path / "store"))
    create_store(store, *tables(spark, 6), buckets=2, notes={compacting.BATCH: 0})
    write_events(spark, [(1, T0, "metadata", 1, None, "/auto/f1", "u")], str(tmp_path / "in" / "part=0"))
    before = rows(store.read("state"))
    compacting.start_store_drain(
        folding.event_source(spark, f"{tmp_path}/in/*"), store, RULES, spark.createDataFrame([], "file_id long, content binary"),
        str(tmp_path / "out"), str(tmp_path / "cp"), now=lambda: 1, trigger={"availableNow": True},
    ).awaitTermination()
    assert rows(compacting.current(store, str(tmp_path / "out"))["state"]) == before


def test_a_failure_after_a_success_keeps_the_packed_hashes(spark, tmp_path):
    first = (1, 900, None, {"sha1": "new"}, "missing", True, None)
    second = (1, 900, "missing", {"sha1": "new"}, "missing", False, "x")
    for b, row in enumerate((first, second)):
        outcome_of(spark, [row]).withColumn("done_at", F.lit(5000 + b)).write.parquet(f"{tmp_path}/batch_id={b}")
    tail = compacting.tail_outcomes(spark, str(tmp_path), [0, 1])
    assert [tuple(r) for r in compacting.packed_outcome(tail).collect()] == [(1, {"sha1": "new"}, True)]
    assert tail.first().next_pending == "missing" and (tail.first().failures, tail.first().done_at) == (1, 5001)


def test_compacted_folds(spark, tmp_path, rows):
    rng, out = random.Random(4), str(tmp_path / "fold")
    store = VersionedStore(spark, str(tmp_path / "store"))
    assert compacting.read_compacted_fold(store, str(tmp_path / "nothing")) is None
    everything = []
    for b in range(5):
        events = [
            (100 * b + e, T0 + dt.timedelta(minutes=rng.randrange(50)), rng.choice(folding.KINDS), rng.randrange(9), None, "/auto/x", "u")
            for e in range(30)
        ]
        everything += events
        folded = folding.fold_events(spark.createDataFrame(events, FILE_EVENTS), RULES)
        folded.write.parquet(f"{out}/batch_id={b}")
        if b in (1, 3):
            compacting.compact_fold(store, out)
        want = rows(folding.fold_events(spark.createDataFrame(everything, FILE_EVENTS), RULES))
        assert rows(compacting.read_compacted_fold(store, out)) == want
    # batches that the version before had already are gone
    assert compacting._batches(spark, out) == [2, 3, 4]
