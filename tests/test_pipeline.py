import hashlib
import json

import pytest
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, ERR_NO_CONTENT, ERR_NOT_FILE, ERR_NOT_FOUND
from fpindex.functions.digests import hex_digests
from fpindex.operators import drain as drains
from fpindex.operators import generate as gen
from fpindex.operators import pending, rehash, status, verify
from fpindex.operators.duplicates import duplicate_members
from fpindex.operators.rules import Rule
from fpindex.plans.api import FingerprintIndex

NOW = 5000
FILES = (
    "fileid long, storage long, path string, name string, size long, mtime long, checksum string,"
    " owner string, is_file boolean"
)
STATE = "file_id long, updated_at long, pending_mode string"
INDEX = "file_id long, algo string, hash string"
CONTENT = "file_id long, content binary"


def sha1(data):
    return hashlib.sha1(data).hexdigest()


class World:
    """A few files with everything the pipelines read."""

    def __init__(self, spark):
        self.spark = spark
        self._files, self._state, self._index, self._content = [], [], [], []

    def file(self, i, path="/u/a.txt", mtime=100, checksum=None, content=b"x", is_file=True, owner="u"):
        self._files.append((i, 1, path, path.rsplit("/", 1)[-1], 1, mtime, checksum, owner, is_file))
        if content is not None:
            self._content.append((i, bytearray(content)))
        return self

    def state_row(self, i, updated_at, mode=None):
        self._state.append((i, updated_at, mode))
        return self

    def hashes(self, i, **hashes):
        self._index += [(i, a.replace("_", "-"), h) for a, h in hashes.items()]
        return self

    def _df(self, rows, schema):
        return self.spark.createDataFrame(rows, schema)

    files = property(lambda self: self._df(self._files, FILES))
    state = property(lambda self: self._df(self._state, STATE))
    index = property(lambda self: self._df(self._index, INDEX))
    content = property(lambda self: self._df(self._content, CONTENT))

    def drain(self, rules=(), **options):
        outcome = drains.drain(
            self.state, self.files, self.index, list(rules), self.content, NOW, **options
        )
        return {r["file_id"]: r for r in outcome.collect()}


@pytest.fixture
def world(spark):
    return World(spark)


def test_lazy_clears_and_computes_nothing(world):
    world.file(1).state_row(1, 50, "lazy").hashes(1, sha1="old")
    row = world.drain()[1]
    assert (row["hashes"], row["updated_at"], row["next_pending"], row["success"]) == ({}, 0, None, True)


def test_lazy_can_compute_at_drain(world):
    world.file(1).state_row(1, 50, "lazy").hashes(1, sha1="old")
    row = world.drain(lazy="compute")[1]
    assert set(row["hashes"]) == set(ALGOS) and row["updated_at"] == NOW
    with pytest.raises(ValueError):
        world.drain(lazy="later")


def test_force_recomputes_everything_even_if_fresh(world):
    world.file(1, content=b"new", checksum="MD5:old").state_row(1, 500, "force").hashes(1, sha1="old")
    row = world.drain()[1]
    assert row["hashes"] == dict(zip(ALGOS, hex_digests([b"new"], ALGOS)))
    assert (row["updated_at"], row["next_pending"], row["computed"]) == (NOW, None, 8)


def test_missing_keeps_what_is_fresh(world):
    world.file(1).state_row(1, 100, "missing").hashes(1, sha1="kept")
    world.file(2).state_row(2, 99, "missing").hashes(2, sha1="stale", md5="stale")
    rows = world.drain()
    assert rows[1]["hashes"]["sha1"] == "kept" and rows[1]["computed"] == 7
    assert rows[2]["hashes"]["sha1"] == sha1(b"x") and rows[2]["computed"] == 8


def test_auto_touches_only_known_algorithms(world):
    world.file(1).state_row(1, 50, "auto").hashes(1, sha1="stale")
    world.file(2).state_row(2, 50, "auto")
    world.file(3, checksum="MD5:old").state_row(3, 50, "auto")
    rows = world.drain()
    assert rows[1]["hashes"] == {"sha1": sha1(b"x")}
    assert (rows[2]["hashes"], rows[2]["updated_at"]) == ({}, NOW)
    assert rows[3]["hashes"] == {"md5": hashlib.md5(b"x").hexdigest()}


def test_new_takes_mode_and_algorithms_of_its_rule(world):
    rules = [Rule("pdf", "**/*.pdf", mode="missing", algos=("sha1", "crc32")), Rule("off", "/off/*", mode="off")]
    world.file(1, path="/u/a.pdf").state_row(1, 0, "new")
    world.file(2, path="/u/a.txt").state_row(2, 0, "new")
    world.file(3, path="/off/a.txt").state_row(3, 7, "new").hashes(3, sha1="x")
    rows = world.drain(rules)
    assert set(rows[1]["hashes"]) == {"sha1", "crc32"}
    assert (rows[2]["mode"], rows[2]["hashes"], rows[2]["updated_at"]) == ("auto", {}, NOW)
    assert (rows[3]["mode"], rows[3]["hashes"], rows[3]["updated_at"], rows[3]["next_pending"]) == (
        "off", {"sha1": "x"}, 7, None,
    )


def test_one_failure_stores_nothing_and_marks_again(world):
    rules = [Rule("r", mode="force", algos=("sha1", "nope"))]
    world.file(1).state_row(1, 7, "new").hashes(1, md5="kept")
    world.file(2, content=None).state_row(2, 7, "force").hashes(2, md5="kept")
    world.state_row(3, 7, "missing")
    world.file(4, is_file=False).state_row(4, 7, "missing")
    rows = world.drain(rules)
    for i, mode in ((1, "force"), (2, "force"), (3, "missing"), (4, "missing")):
        assert (rows[i]["success"], rows[i]["next_pending"], rows[i]["updated_at"]) == (False, mode, 7)
    assert rows[1]["hashes"] == rows[2]["hashes"] == {"md5": "kept"}
    assert [rows[i]["error"] for i in (1, 2, 3, 4)] == [
        "Unsupported algorithm: nope", ERR_NO_CONTENT, ERR_NOT_FOUND, ERR_NOT_FILE,
    ]


def test_tables_after_a_drain(world, rows):
    world.file(1).state_row(1, 50, "auto").hashes(1, sha1="stale")
    world.file(2).state_row(2, 60).hashes(2, sha1="other")
    world.file(3).state_row(3, 50, "lazy").hashes(3, sha1="gone")
    outcome = drains.drain(world.state, world.files, world.index, [], world.content, NOW)
    assert rows(drains.drained_state(world.state, outcome)) == [(1, NOW, None), (2, 60, None), (3, 0, None)]
    assert rows(drains.drained_index(world.index, outcome)) == [(1, "sha1", sha1(b"x")), (2, "sha1", "other")]
    state, index, settled = drains.settle(world.state, world.index, outcome)
    assert rows(state) == rows(drains.drained_state(world.state, outcome))
    assert rows(index) == rows(drains.drained_index(world.index, outcome)) and settled.count() == 2
    assert rows(drains.drain_totals(outcome)) == [("auto", 1, 0), ("lazy", 1, 0)]


def test_part_of_a_queue(world):
    for i in range(20):
        world.file(i, content=b"%d" % i).state_row(i, 0, "force" if i % 2 else "missing")
    everything = world.drain()
    assert len(everything) == 20 and sorted(world.drain(batch=5)) == [0, 1, 2, 3, 4]
    assert all(everything[i]["hashes"]["md5"] == hashlib.md5(b"%d" % i).hexdigest() for i in range(20))


def test_a_small_part_of_a_store(world, rows):
    for i in range(20):
        world.file(i, content=b"%d" % i).hashes(i, md5="old")
    world.state_row(3, 0, "missing").state_row(4, 0, "auto").state_row(5, 500)
    drained = world.drain()
    assert {i: set(r["hashes"]) for i, r in drained.items()} == {3: set(ALGOS), 4: {"md5"}}
    ids = world.spark.createDataFrame([(3,), (3,), (77,)], "file_id long")
    requests = rehash.request_all(ids, ["md5", "crc32"])
    tables = (world.files, world.index, world.state, world.content)
    got = rows(rehash.rehash(requests, *tables).select("file_id", "algo", "success", "error"))
    assert got == [
        (3, "crc32", True, None), (3, "md5", True, None), (77, "crc32", False, ERR_NOT_FOUND), (77, "md5", False, ERR_NOT_FOUND)
    ]


def test_rebuild_seeds_first(world):
    world.file(1).file(2).state_row(1, 500)
    outcome = drains.rebuild(
        world.files, world.state, world.index, [Rule("r", mode="missing", algos=("md5",))], world.content, NOW
    ).collect()
    assert [(r["file_id"], r["mode"], set(r["hashes"])) for r in outcome] == [(2, "missing", {"md5"})]


def test_queue_tables(world, rows):
    spark = world.spark
    world.file(1).file(2).file(3)
    world.state_row(1, 5, "auto").state_row(2, 6)
    world.file(4, is_file=False)
    assert rows(pending.seed_pending(world.files, world.state)) == [(3, 0, "new")]
    marks = spark.createDataFrame([(2, "force"), (3, "force")], "file_id long, mode string")
    assert rows(pending.mark_pending(world.state, marks)) == [(1, 5, "auto"), (2, 6, "force")]
    ids = spark.createDataFrame([(1,), (1,)], "file_id long")
    assert rows(pending.clear_state(world.state, ids)) == [(1, 0, None), (2, 6, None)]
    assert rows(pending.pending_stats(world.state)) == [("auto", 1)]
    assert rows(pending.pending_batch(world.state, 9)) == [(1, 5, "auto")]
    world.hashes(1, sha1="a").hashes(2, sha1="b")
    assert rows(pending.clear_index(world.index, ids)) == [(2, "sha1", "b")]
    row = status.status(world.files, world.index, world.state).first().asDict(recursive=True)
    assert row["pending_by_mode"]["auto"] == row["pending_total"] == 1
    assert (row["filecache_rows"], row["hash_rows"], row["metadata_rows"]) == (4, 2, 2)


def test_copied_checksums(world, rows):
    spark = world.spark
    world.file(1, checksum="SHA1:a").file(2, checksum=None).file(3, checksum="SHA1:c").file(9)
    copies = spark.createDataFrame(
        [(1, 9, 1, 1), (3, 9, 2, 2), (2, 9, 3, 3), (2, 1, 1, 4), (1, 77, 1, 5)],
        "source_file_id long, file_id long, ts long, event_id long",
    )
    assert rows(pending.copy_checksums(world.files, copies)) == [(9, "SHA1:c")]


def test_rehash_rows(world, rows):
    world.file(1, checksum="MD5:packed").state_row(1, 100).hashes(1, sha1="known")
    world.file(2).file(3, is_file=False)
    wanted = world.spark.createDataFrame(
        [(1, ["SHA1", "sha1", "md5", "crc32"]), (2, ["nope"]), (3, ["sha1"]), (4, ["sha1"])],
        "file_id long, requested array<string>",
    )
    crc = hex_digests([b"x"], ["crc32"])[0]
    results = rehash.rehash(wanted, world.files, world.index, world.state, world.content)
    assert rows(results) == [
        (1, "crc32", True, crc, False, None),
        (1, "md5", True, "packed", True, None),
        (1, "sha1", True, "known", True, None),
        (2, "nope", False, "", False, "Unsupported algorithm: nope"),
        (3, "sha1", False, "", False, ERR_NOT_FILE),
        (4, "sha1", False, "", False, ERR_NOT_FOUND),
    ]
    made = rehash.new_index_rows(results)
    assert rows(rehash.replace_index_rows(world.index, made)) == [(1, "crc32", crc), (1, "sha1", "known")]
    again = rehash.rehash(
        wanted, world.files, world.index, world.state, world.content, skip_existing=False
    )
    assert not again.filter("existed").count()


def test_recalc_existing_uses_the_algorithms_a_file_has(world):
    world.file(1).hashes(1, md5="old").file(2)
    results = rehash.recalc_existing(world.files, world.index, world.state, world.content).collect()
    assert {(r["file_id"], r["algo"]) for r in results} == {(1, "md5"), (2, "sha1")}
    assert all(r["success"] and not r["existed"] for r in results)


def test_generate(world, rows):
    world.file(1, path="files/a.txt", checksum="SHA1:x").file(2, path="files/b/c.txt")
    world.file(3, path="files/d.pdf").file(4, path="files/e.txt", owner="v")
    results = gen.generate_missing(
        world.files, world.index, world.state, world.content, ["sha1"], "*.txt"
    )
    assert {r["file_id"] for r in results.collect()} == {2, 4}
    assert rows(gen.generate_totals(results)) == [(2, 0)]
    assert rows(gen.candidates(world.files, ["sha1"], budget=2).select("fileid")) == [(2,), (3,)]
    assert rows(gen.candidates(world.files, ["sha1"], scope="v").select("fileid")) == [(4,)]
    assert rows(gen.walk_stats(world.files, ["sha1"], "*.txt")) == [(4, 1, 1, 2)]
    assert rows(gen.mark_matching(world.files, "*.txt", budget=2)) == [(1, "auto"), (2, "auto")]
    assert rows(gen.glob_search(world.files, "files/?.*", 2).select("fileid")) == [(1,), (3,)]


def test_verification(world, rows):
    for i, data in enumerate((b"same", b"same", b"changed", None), 1):
        world.file(i, content=data).hashes(i, sha1=sha1(b"same"), md5=f"m{i // 3}")
    members = duplicate_members(world.index, "sha1")
    checked = verify.verify_members(members, world.content, ["sha1"])
    assert rows(checked.select("file_id", "verified", "verify_error")) == [
        (1, True, None),
        (2, True, None),
        (3, False, None),
        (4, False, ERR_NO_CONTENT),
    ]
    groups = verify.verify_groups(checked)
    assert rows(groups) == [("sha1", sha1(b"same"), 4, 2, 2)]
    assert verify.verified_only(groups).count() == verify.matching_only(groups).count() == 0
    counted = verify.with_group_counts(checked, hot_rows=2)
    assert rows(counted.select("file_id", "file_count", "match_count", "mismatch_count")) == [
        (i, 4, 2, 2) for i in (1, 2, 3, 4)
    ]
    storages = world.spark.createDataFrame([(1, "home::u")], "numeric_id long, id string")
    store = FingerprintIndex(world.files, storages, world.index, world.state, world.content)
    report = json.loads(store.verified_report("sha1").first()["json"])
    assert (report["match_count"], report["mismatch_count"]) == (2, 2)
    assert [f["verified"] for f in report["files"]] == [True, True, False, False]
    assert store.verified_report("sha1", only_verified=True).count() == 0
    assert rows(store.same_hash([3], user="u").select("algo", "fileid")) == [
        ("md5", 4), ("sha1", 1), ("sha1", 2), ("sha1", 4),
    ]
    assert store.same_hash([3], user="v").count() == 0
    unchecked = groups.withColumn("mismatch_count", F.lit(None).cast("long"))
    assert (verify.verified_only(unchecked).count(), verify.matching_only(unchecked).count()) == (0, 1)


def test_users_cannot_recalculate_foreign_files(world):
    storages = world.spark.createDataFrame([(1, "home::u")], "numeric_id long, id string")
    world.file(1)
    store = FingerprintIndex(world.files.drop("owner"), storages, world.index, world.state, world.content)
    assert store.recalc([1], user="u").first()["success"]
    assert store.recalc([1], user="v").first()["error"] == ERR_NOT_FOUND
    assert {r["file_id"] for r in store.generate().collect()} == {1}
    assert store.seed().count() == 1


def test_old_packed_hashes_do_not_come_back(world, spark):
    """A drain replaces the packed column, so that the next one cannot take old hashes for fresh ones."""
    world.file(1, checksum="SHA1:old", content=b"new").file(2, checksum="MD5:x", content=None)
    world.state_row(1, 0, "force").state_row(2, 0, "missing")
    rules = []
    outcome = drains.drain(world.state, world.files, world.index, rules, world.content, 200)
    state, index, outcome = drains.settle(world.state, world.index, outcome)
    files = drains.drained_files(world.files, outcome)
    packed = {r["fileid"]: r["checksum"] for r in files.collect()}
    assert f"SHA1:{sha1(b'new')}" in packed[1] and packed[2] == "MD5:x"
    marked = pending.mark_pending(state, spark.createDataFrame([(1, "missing")], "file_id long, mode string"))
    again = drains.drain(marked, files, index, rules, world.content, 300).filter("file_id = 1").first()
    assert again["success"] and again["hashes"]["sha1"] == sha1(b"new")


def test_cleared_files_have_an_empty_packed_column(world):
    world.file(1, checksum="SHA1:old").state_row(1, 50, "lazy")
    outcome = drains.drain(world.state, world.files, world.index, [], world.content, NOW)
    assert drains.drained_files(world.files, outcome).first()["checksum"] == ""


def test_rebuild_keeps_the_seeds_it_does_not_drain(world, rows):
    for i in range(5):
        world.file(i)
    outcome = drains.rebuild(world.files, world.state, world.index, [], world.content, NOW, batch=2)
    state = drains.rebuilt_state(world.files, world.state, outcome)
    assert [r["pending_mode"] for r in state.orderBy("file_id").collect()] == [None, None, "new", "new", "new"]


def test_several_marks_of_a_file(world, spark):
    world.state_row(1, 0).state_row(2, 0)
    marks = [(1, "new", 1), (1, "force", 2), (1, "auto", 3), (2, "lazy", 5), (2, "missing", 4)]
    timed = spark.createDataFrame(marks, "file_id long, mode string, ts long")
    got = {r["file_id"]: r["pending_mode"] for r in pending.mark_pending(world.state, timed).collect()}
    assert got == {1: "auto", 2: "lazy"}
    got = {r["file_id"]: r["pending_mode"] for r in pending.mark_pending(world.state, timed.drop("ts")).collect()}
    assert got == {1: "force", 2: "missing"}
