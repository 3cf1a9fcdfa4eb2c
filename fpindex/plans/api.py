"""The query API: one object over the tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, DEFAULT_ALGO, SCOPE_ALL
from fpindex.operators import drain as drains
from fpindex.operators import duplicates as dups
from fpindex.operators import generate as gen
from fpindex.operators import lookup, paths, pending, rehash, status, verify
from fpindex.operators import rules as ruling
from fpindex.sources.reports import duplicates_to_json
from fpindex.sources.versions import VersionedStore


@dataclass
class FingerprintIndex:
    """Tables of one store and the questions to ask about them.

    Nothing runs until a result is used, except that hashing plans, pages and
    budgets are computed once into the checkpoint folder when they are asked for
    (see ``fpindex.operators.rehash`` and ``fpindex.operators.ranked``).
    """

    files: DataFrame
    storages: DataFrame
    index: DataFrame
    state: DataFrame
    content: rehash.Content | None = None
    rules: Sequence[ruling.Rule] = field(default_factory=tuple)

    @classmethod
    def of_store(
        cls,
        store: VersionedStore,
        storages: DataFrame,
        content: rehash.Content | None = None,
        rules: Sequence[ruling.Rule] = (),
        version: int | None = None,
    ) -> FingerprintIndex:
        """The tables of a version, by default the last one."""
        shown = store.version(version)
        files, index, state = (store.read(t, shown) for t in ("files", "index", "state"))
        return cls(files.drop("owner"), storages, index, state, content, rules)

    @property
    def owned_files(self) -> DataFrame:
        return paths.with_owner(self.files, self.storages)

    def _ids(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return ids
        spark = self.files.sparkSession
        return spark.createDataFrame([(int(i),) for i in ids], "file_id long")

    # -- lookups -------------------------------------------------------------

    def find_by_hash(
        self, value: str, algo: str | None = None, limit: int = 100, user: str | None = None
    ) -> DataFrame:
        return lookup.find_by_hash(
            self.index, self.files, self.storages, value, algo, limit, user
        )

    def find_by_hashes(self, probes: DataFrame, user: str | None = None) -> DataFrame:
        return lookup.find_by_hashes(self.index, self.files, self.storages, probes, user)

    def search(self, terms: DataFrame, user: str | None = None, strict: bool = False) -> DataFrame:
        return lookup.search_terms(self.index, self.files, self.storages, terms, user, strict)

    def hashes_of(
        self, ids: Sequence[int] | DataFrame | None = None, user: str | None = None
    ) -> DataFrame:
        """Hash listing; with ``user`` only of files that user sees."""
        wanted = None
        if ids is not None:
            wanted = self._ids(ids).select(F.col("file_id").alias("fileid"))
        if user is not None:
            seen = paths.visible_files(self.files, self.storages, user)
            wanted = seen if wanted is None else wanted.join(seen, "fileid", "left_semi")
        return lookup.hashes_by_file(self.index, self.state, wanted)

    def hashes_by_path(self, wanted: DataFrame, by_user: bool = False) -> DataFrame:
        """Hash listing for a table of paths, or of ``(owner, path)`` with ``by_user``."""
        found = paths.files_by_path(self.files, self.storages, wanted, by_user)
        return lookup.hashes_by_file(self.index, self.state, found.select("fileid")).join(
            found, "fileid"
        )

    def same_hash(self, ids: Sequence[int] | DataFrame, user: str | None = None) -> DataFrame:
        """Other files with a hash of the given ones; with ``user`` those that user sees."""
        if user is None:
            return dups.same_hash(self.index, self._ids(ids))
        return dups.same_hash_with_paths(
            self.index, self._ids(ids), self.files, self.storages, user
        )

    # -- duplicates ----------------------------------------------------------

    def duplicate_groups(self, algo: str | None = None, min_count: int = 2) -> DataFrame:
        return dups.duplicate_groups(self.index, algo, min_count)

    def find_duplicates(
        self,
        algo: str | None = None,
        min_count: int = 2,
        limit: int = 50,
        offset: int = 0,
        user: str | None = None,
    ) -> DataFrame:
        """One page of the groups a user sees, filtered before it is cut."""
        groups = dups.visible_groups(
            self.index, self.files, self.storages, user, algo, min_count
        )
        return dups.page(groups, limit, offset)

    def duplicates_with_paths(
        self, algo: str | None = None, min_count: int = 2, user: str | None = None
    ) -> DataFrame:
        return dups.duplicates_with_paths(
            self.index, self.files, self.storages, user, algo, min_count
        )

    def duplicates_json(self, **options) -> DataFrame:
        return duplicates_to_json(self.duplicates_with_paths(**options))

    def verify_duplicates(self, algo: str | None = None, min_count: int = 2) -> DataFrame:
        """Groups with their match and mismatch counts, recomputed from the contents."""
        members = dups.duplicate_members(self.index, algo, min_count)
        algos = ALGOS if algo is None else (algo.lower(),)
        return verify.verify_groups(verify.verify_members(members, self.content, algos))

    def verified_report(
        self,
        algo: str | None = None,
        min_count: int = 2,
        user: str | None = None,
        only_verified: bool = False,
    ) -> DataFrame:
        """JSON objects of the duplicate groups with paths, checked against the contents."""
        members = self.duplicates_with_paths(algo, min_count, user)
        algos = ALGOS if algo is None else (algo.lower(),)
        checked = verify.with_group_counts(verify.verify_members(members, self.content, algos))
        return duplicates_to_json(verify.verified_only(checked) if only_verified else checked)

    # -- hashing -------------------------------------------------------------

    def recalc(
        self,
        ids: Sequence[int] | DataFrame,
        algos: Sequence[str] = (DEFAULT_ALGO,),
        skip_existing: bool = True,
        user: str | None = None,
    ) -> DataFrame:
        wanted = self._ids(ids)
        files = self.files
        if user is not None:
            # to a user, a file they do not see does not exist
            seen = paths.visible_files(files, self.storages, user)
            files = files.join(seen, "fileid", "left_semi")
        return rehash.rehash(
            rehash.request_all(wanted, algos),
            files,
            self.index,
            self.state,
            self.content,
            algos,
            skip_existing,
        )

    def recalc_existing(self) -> DataFrame:
        return rehash.recalc_existing(self.files, self.index, self.state, self.content)

    def generate(
        self,
        algos: Sequence[str] = (DEFAULT_ALGO,),
        scope: str = SCOPE_ALL,
        glob: str | None = None,
        budget: int | None = None,
    ) -> DataFrame:
        return gen.generate_missing(
            self.owned_files, self.index, self.state, self.content, algos, glob, scope, budget
        )

    # -- queue ---------------------------------------------------------------

    def seed(self) -> DataFrame:
        return pending.seed_pending(self.files, self.state)

    def evaluate_rules(self, cap: int | None = None) -> DataFrame:
        evaluated = ruling.evaluate_rules(self.owned_files, self.rules, self.state)
        return evaluated if cap is None else ruling.cap_marks(evaluated, cap)

    def drain(self, now: int, lazy: str = "clear", batch: int | None = None) -> DataFrame:
        return drains.drain(
            self.state, self.owned_files, self.index, self.rules, self.content, now, lazy, batch
        )

    def drained_tables(self, now: int, lazy: str = "clear", batch: int | None = None):
        """State, index and outcome after a drain, computed once."""
        return drains.settle(self.state, self.index, self.drain(now, lazy, batch))

    def rebuild(self, now: int, lazy: str = "clear", batch: int | None = None) -> DataFrame:
        return drains.rebuild(
            self.owned_files, self.state, self.index, self.rules, self.content, now, lazy, batch
        )

    def status(self) -> DataFrame:
        return status.status(self.files, self.index, self.state)

    def pending_stats(self) -> DataFrame:
        return pending.pending_stats(self.state)
