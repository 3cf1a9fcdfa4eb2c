import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fpindex.functions.digests import hex_digests
from fpindex.operators.rules import Rule
from fpindex.schemas import FILE_EVENTS
from fpindex.streaming import drain as draining
from fpindex.streaming import fold as folding

MODES = ("force", "lazy", "auto", "missing", "off")
RULES = [Rule(m, f"/{m}/*", mode=m) for m in MODES]
STATE = "file_id long, updated_at long, pending_mode string"
INDEX = "file_id long, algo string, hash string"
T0 = dt.datetime(2024, 1, 1)


def sequential(state, hashed, events, modes):
    """The events one after another, as a plain loop."""
    result = {i: [u, m, n, False] for i, (u, m, n) in state.items()}
    for event in sorted(events, key=lambda e: (e[1], e[0])):
        _, _, kind, i, _, path, _ = event
        entry = result.setdefault(i, [0, None, 0, False])
        mode = modes.get(path.split("/")[1])

        def clear():
            entry[0], entry[1], entry[2], entry[3] = 0, None, 0, True

        if kind == "copied":
            entry[1] = "auto"
        elif kind == "metadata":
            entry[1] = "missing" if entry[2] else "new"
        elif kind == "deleted":
            if mode and mode != "off":
                clear()
        elif kind in ("written", "created"):
            if mode == "force" or (mode == "lazy" and kind == "written"):
                clear()
                entry[1] = mode
            elif mode == "lazy":
                entry[1] = mode
            elif mode == "auto" and entry[2]:
                entry[1] = "auto"
    return {i: tuple(e) for i, e in result.items()}


def random_world(seed, n_files=40, n_events=400):
    rng = random.Random(seed)
    path = {i: f"/{rng.choice([*MODES, 'none'])}/f{i}" for i in range(n_files)}
    state = {
        i: (rng.randint(1, 9), rng.choice([None, "new"]), rng.randint(0, 2))
        for i in range(n_files)
        if rng.random() < 0.8
    }
    events = []
    for e in range(n_events):
        i = 0 if rng.random() < 0.3 else rng.randrange(n_files)
        kind = rng.choice([*folding.KINDS, "other"])
        events.append((e, T0 + dt.timedelta(minutes=rng.randint(0, 50)), kind, i, None, path[i], "u"))
    return state, events


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_equals_the_events_in_sequence(spark, seed):
    state, events = random_world(seed)
    df = spark.createDataFrame(events, FILE_EVENTS)
    states = spark.createDataFrame([(i, u, m) for i, (u, m, _) in state.items()], STATE)
    index = spark.createDataFrame(
        [(i, f"a{k}", "h") for i, (_, _, n) in state.items() for k in range(n)], INDEX
    )
    applied = folding.apply_fold(states, index, folding.fold_events(df, RULES), upsert=True)
    found = {r["file_id"]: tuple(r)[1:] for r in applied.collect()}
    expected = sequential(state, None, events, {m: m for m in MODES})
    touched = {e[3] for e in events if e[2] in folding.KINDS}
    effective = {r["file_id"] for r in folding.fold_events(df, RULES).collect()}
    assert found == {i: v for i, v in expected.items() if i in state or i in effective}
    assert effective <= touched

    # without upsert only files that have a row change
    kept = folding.apply_fold(states, index, folding.fold_events(df, RULES)).collect()
    assert {r["file_id"] for r in kept} == set(state)


def write_events(spark, events, folder, name):
    (
        spark.createDataFrame(events, FILE_EVENTS)
        .coalesce(1)
        .write.mode("append")
        .parquet(f"{folder}/{name}")
    )


def test_streamed_fold_equals_the_batch_fold(spark, tmp_path, rows):
    _, events = random_world(5, n_events=300)
    random.Random(0).shuffle(events)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for k in range(3):
        write_events(spark, events[k::3], folder, f"part={k}")
    for bucket in (None, "10 minutes"):
        source = folding.event_source(spark, f"{folder}/*")
        run = folding.start_fold(
            source, RULES, f"{out}{bucket}", f"{checkpoint}{bucket}", bucket, trigger={"availableNow": True}
        )
        run.awaitTermination()
        batch = folding.fold_events(spark.createDataFrame(events, FILE_EVENTS), RULES)
        assert rows(folding.read_fold(spark, f"{out}{bucket}")) == rows(batch)


def test_located_events_fold_alike(spark, rows):
    _, events = random_world(6)
    df = spark.createDataFrame(events, FILE_EVENTS)
    files = df.select(F.col("file_id").alias("fileid"), "path", "owner").distinct()
    located = folding.locate_events(df.drop("path", "owner"), files)
    assert rows(folding.fold_events(located, RULES)) == rows(folding.fold_events(df, RULES))


def test_deletions_of_files_that_are_gone_clear_them(spark):
    events = [
        (1, T0, "written", 1, None, None, None), (2, T0, "deleted", 1, None, None, None),
        (3, T0, "written", 2, None, None, None), (4, T0, "deleted", 3, None, None, None),
    ]
    df = spark.createDataFrame(events, FILE_EVENTS)
    files = spark.createDataFrame([(3, "/keep/x", "u")], "fileid long, path string, owner string")
    rules = [Rule("off", mode="off")]
    located = folding.locate_events(df, files)
    cleared = {r["file_id"]: r["cleared"] is not None for r in folding.fold_events(located, rules).collect()}
    assert cleared == {1: True, 3: False}
    assert sorted(r["event_id"] for r in folding.quarantine_events(df, files).collect()) == [1, 3]


def test_bad_events_are_set_aside(spark):
    events = [(1, T0, "written", None, None, "/x", "u"), (2, None, "deleted", 1, None, "/x", "u"), (3, T0, "odd", None, None, "/x", "u")]
    df = spark.createDataFrame(events, FILE_EVENTS)
    assert folding.quarantine_events(df).count() == 2
    assert folding.usable(df).count() == 0


def test_events_are_drained_to_hashes(spark, tmp_path):
    files = spark.createDataFrame(
        [(i, 1, p, p, 1, 100, "MD5:zz" if i == 3 else None, "u") for i, p in enumerate(("/force/a", "/lazy/b", "/auto/c", "/none/d"))],
        "fileid long, storage long, path string, name string, size long, mtime long, checksum string, owner string",
    )
    tables = draining.Tables(
        files,
        spark.createDataFrame([(2, 50, None), (3, 50, None)], STATE),
        spark.createDataFrame([(2, "sha1", "old"), (3, "md5", "kept")], INDEX),
    )
    content = spark.createDataFrame([(i, bytearray(b"c%d" % i)) for i in range(4)], "file_id long, content binary")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))

    def run(now):
        stream = draining.start_drain(
            folding.event_source(spark, f"{folder}/*"), tables, RULES, content, out, checkpoint,
            now=lambda: now, algos=("sha1", "md5", "adler32", "crc32", "sha256", "sha512", "sha3-256", "sha3-512"),
            trigger={"availableNow": True},
        )
        stream.awaitTermination()
        state, index = draining.current_tables(spark, tables, out)
        return (
            {r["file_id"]: (r["updated_at"], r["pending_mode"]) for r in state.collect()},
            {(r["file_id"], r["algo"]): r["hash"] for r in index.collect()},
        )

    write_events(spark, [
        (1, T0, "created", 0, None, "/force/a", "u"),
        (2, T0, "created", 1, None, "/lazy/b", "u"),
        (3, T0, "written", 2, None, "/auto/c", "u"),
        (4, T0, "written", 3, None, "/none/d", "u"),
    ], folder, "part=0")
    state, index = run(1000)
    assert state == {0: (1000, None), 1: (0, None), 2: (1000, None), 3: (50, None)}
    assert index[0, "sha1"] == hex_digests([b"c0"], ["sha1"])[0]
    assert index[2, "sha1"] == hex_digests([b"c2"], ["sha1"])[0]
    assert index[3, "md5"] == "kept" and len(index) == 10

    # a restart goes on where the first run ended
    write_events(spark, [
        (5, T0 + dt.timedelta(hours=1), "deleted", 0, None, "/force/a", "u"),
        (6, T0 + dt.timedelta(hours=1), "metadata", 3, None, "/none/d", "u"),
        (7, T0 + dt.timedelta(hours=1), "copied", 1, 3, "/lazy/b", "u"),
    ], folder, "part=1")
    state, index = run(2000)
    assert state == {0: (0, None), 1: (2000, None), 2: (1000, None), 3: (2000, None)}
    assert {a for i, a in index if i == 3} == set(("sha1", "md5", "adler32", "crc32", "sha256", "sha512", "sha3-256", "sha3-512"))
    assert not any(i == 0 for i, _ in index)
    # the copy inherits a packed md5, so auto has something to recalculate
    assert {k: h for k, h in index.items() if k[0] == 1} == {(1, "md5"): hex_digests([b"c1"], ["md5"])[0]}


def test_json_messages(spark):
    values = ['{"event_id":1,"ts":"2024-01-01T00:00:00Z","kind":"written","file_id":5,"path":"/force/x"}', "{broken", "[]"]
    events = folding.parse_events(spark.createDataFrame([(v,) for v in values], "value string"))
    assert [(r["kind"], r["file_id"]) for r in folding.usable(events).collect()] == [("written", 5)]
    assert folding.quarantine_events(events).count() == 2
