"""Working off the pending queue: the mode of a file decides what happens to it.

| mode | effect |
|---|---|
| new | becomes mode and algorithms of the first matching rule, else auto with all |
| missing | what is not known and fresh is computed; the file is fresh from now on |
| force | hashes are cleared, then as missing |
| auto | as missing, but only for algorithms the file already has |
| lazy | hashes are cleared; nothing is computed unless ``lazy="compute"`` |
| other | nothing but the marker changes |

If any algorithm of a file fails, nothing of that file is stored and it is
marked again with its mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import (
    ALGOS,
    MODE_AUTO,
    MODE_FORCE,
    MODE_LAZY,
    MODE_MISSING,
    MODE_NEW,
)
from fpindex.functions import codec
from fpindex.operators.asked import id_filter, reduce_tables
from fpindex.operators.pending import pending, pending_batch, seed_pending
from fpindex.operators.rehash import (
    NO_HASHES,
    Content,
    algo_array,
    needed_of,
    with_results,
)
from fpindex.operators.rules import Rule, fresh, match_rules
from fpindex.operators.wide import known_hashes, wide_index
from fpindex.session import cut_lineage

_EMPTY = "array<string>"


def plan_drain(
    queue: DataFrame,
    files: DataFrame,
    index: DataFrame,
    rules: Sequence[Rule],
    lazy: str = "clear",
) -> DataFrame:
    """What each queued file needs: its resolved mode and algorithms.

    ``queue`` has ``file_id, updated_at, pending_mode``; ``files`` has ``owner``.
    """
    is_file = F.col("is_file") if "is_file" in files.columns else F.lit(True)
    listed = files.select(
        F.col("fileid").alias("file_id"),
        "path",
        "owner",
        "mtime",
        "checksum",
        is_file.alias("is_file"),
        F.lit(True).alias("found"),
    )
    rows = queue.select("file_id", "updated_at", "pending_mode").join(listed, "file_id", "left")
    rows = match_rules(rows.join(wide_index(index), "file_id", "left"), rules)
    is_new = F.col("pending_mode") == MODE_NEW
    every = algo_array(ALGOS)
    rows = rows.select(
        "file_id",
        "updated_at",
        "mtime",
        "pending_mode",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("is_file", F.lit(False)).alias("is_file"),
        F.when(is_new, F.coalesce("rule_mode", F.lit(MODE_AUTO)))
        .otherwise(F.col("pending_mode"))
        .alias("mode"),
        F.when(is_new, F.coalesce("rule_algos", every)).otherwise(every).alias("algos"),
        known_hashes(F.col("hashes"), F.col("checksum")).alias("before"),
    )
    clears = F.col("mode").isin(MODE_FORCE, MODE_LAZY)
    rows = rows.withColumn(
        "known", F.when(clears, F.create_map().cast(NO_HASHES)).otherwise(F.col("before"))
    )
    full = [MODE_FORCE, MODE_MISSING] + ([MODE_LAZY] if lazy == "compute" else [])
    requested = (
        F.when(F.col("mode").isin(full), F.transform("algos", lambda a: F.lower(a)))
        .when(
            F.col("mode") == MODE_AUTO,
            F.filter("algos", lambda a: F.map_contains_key(F.col("known"), a)),
        )
        .otherwise(F.array().cast(_EMPTY))
    )
    rows = rows.withColumn("requested", F.array_distinct(requested))
    is_fresh = ~clears & fresh(F.col("updated_at"), F.col("mtime"))
    needed = needed_of(F.col("requested"), F.col("known"), is_fresh, skip_existing=True)
    usable = F.col("found") & F.col("is_file")
    return rows.withColumn(
        "needed", F.when(usable, needed).otherwise(F.array().cast(_EMPTY))
    )


def drain(
    state: DataFrame,
    files: DataFrame,
    index: DataFrame,
    rules: Sequence[Rule],
    content: Content,
    now: int,
    lazy: str = "clear",
    batch: int | None = None,
    algos: Sequence[str] = ALGOS,
) -> DataFrame:
    """Outcome of every pending file.

    ``(file_id, pending_mode, mode, success, updated_at, next_pending, hashes,
    computed, error)``: ``hashes`` are all hashes the file has afterwards,
    ``computed`` how many of them are new. Without ``batch`` the whole backlog is
    worked off. Derive the new tables from the outcome with
    :func:`drained_state` and :func:`drained_index`; cut its lineage first, so
    that contents are read once.
    """
    if lazy not in ("clear", "compute"):
        raise ValueError("lazy is 'clear' or 'compute'")
    queue = pending(state) if batch is None else pending_batch(state, max(1, batch))
    queue = cut_lineage(queue)
    wanted = id_filter(queue)
    files, index = reduce_tables(wanted, files, index)
    done = with_results(plan_drain(queue, files, index, rules, lazy), content, algos, wanted)
    success = F.forall("results", lambda r: r["success"])
    made = F.map_from_entries(
        F.transform("results", lambda r: F.struct(r["algo"].alias("k"), r["hash"].alias("v")))
    )
    kept = F.map_filter("known", lambda k, _: ~F.array_contains("requested", k))
    hashing = F.col("mode").isin(MODE_FORCE, MODE_MISSING, MODE_AUTO)
    if lazy == "compute":
        hashing = hashing | (F.col("mode") == MODE_LAZY)
    updated = (
        F.when(~success, F.col("updated_at"))
        .when(hashing, F.lit(now).cast("long"))
        .when(F.col("mode") == MODE_LAZY, F.lit(0).cast("long"))
        .otherwise(F.col("updated_at"))
    )
    return done.select(
        "file_id",
        "pending_mode",
        "mode",
        success.alias("success"),
        updated.alias("updated_at"),
        F.when(~success, F.col("mode")).alias("next_pending"),
        F.when(success, F.map_concat(kept, made)).otherwise(F.col("before")).alias("hashes"),
        F.when(
            success, F.size(F.filter("results", lambda r: ~r["existed"])).cast("long")
        ).otherwise(F.lit(0).cast("long")).alias("computed"),
        F.element_at(
            F.concat(
                F.transform(F.filter("results", lambda r: ~r["success"]), lambda r: r["error"]),
                F.array(F.lit(None).cast("string")),
            ),
            1,
        ).alias("error"),
    )


def drained_state(state: DataFrame, outcome: DataFrame) -> DataFrame:
    """State table after a drain."""
    changed = outcome.select(
        "file_id", "updated_at", F.col("next_pending").alias("pending_mode")
    )
    kept = state.select("file_id", "updated_at", "pending_mode").join(
        changed.select("file_id"), "file_id", "left_anti"
    )
    return kept.unionByName(changed)


def outcome_index(outcome: DataFrame) -> DataFrame:
    """Index rows of the drained files."""
    return outcome.select("file_id", F.explode_outer("hashes").alias("algo", "hash")).filter(
        F.col("hash").isNotNull()
    )


def drained_index(index: DataFrame, outcome: DataFrame) -> DataFrame:
    """Index table after a drain."""
    return index.join(outcome.select("file_id"), "file_id", "left_anti").unionByName(
        outcome_index(outcome)
    )


def drained_files(files: DataFrame, outcome: DataFrame) -> DataFrame:
    """Inventory after a drain: the packed column of a drained file has its hashes and no others.

    A later drain takes packed hashes for known ones, as fresh as the state
    says; old ones must not outlive the drain that replaced them. The column of
    a file that was cleared is empty, that of a failed file stays as it is.
    """
    done = outcome.filter("success").select(
        F.col("file_id").alias("fileid"),
        codec.pack_checksums(F.col("hashes"), None).alias("_packed"),
        F.lit(True).alias("_done"),
    )
    packed = F.when(F.col("_done"), F.col("_packed")).otherwise(F.col("checksum"))
    joined = files.join(done, "fileid", "left").withColumn("checksum", packed)
    return joined.select(*files.columns)


def settle(
    state: DataFrame, index: DataFrame, outcome: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """State, index and outcome of a drain that is computed once for all of them.

    Drain again only with the inventory of :func:`drained_files`.
    """
    outcome = cut_lineage(outcome)
    return drained_state(state, outcome), drained_index(index, outcome), outcome


def drain_totals(outcome: DataFrame) -> DataFrame:
    """Files processed and failed per pending mode."""
    return outcome.groupBy("pending_mode").agg(
        F.count_if("success").alias("processed"), F.count_if(~F.col("success")).alias("failed")
    )


def seeded_state(files: DataFrame, state: DataFrame) -> DataFrame:
    """State with a row for every file."""
    return state.select("file_id", "updated_at", "pending_mode").unionByName(
        seed_pending(files, state)
    )


def rebuilt_state(files: DataFrame, state: DataFrame, outcome: DataFrame) -> DataFrame:
    """State after a rebuild: what was drained, and the seeds that were not."""
    return drained_state(seeded_state(files, state), outcome)


def rebuild(
    files: DataFrame,
    state: DataFrame,
    index: DataFrame,
    rules: Sequence[Rule],
    content: Content,
    now: int,
    lazy: str = "clear",
    batch: int | None = None,
    algos: Sequence[str] = ALGOS,
) -> DataFrame:
    """Seed untracked files, then drain the queue; the outcome of the drain.

    With ``batch`` some seeds stay in the queue: store :func:`rebuilt_state`.
    """
    return drain(
        seeded_state(files, state), files, index, rules, content, now, lazy, batch, algos
    )
