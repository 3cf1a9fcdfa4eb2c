"""Registered queries: one per operator, over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.constants import ALGOS
from fpindex.functions import codec, digests, globs, paths
from fpindex.functions.sql import register_functions
from fpindex.operators import copies as copying
from fpindex.operators import drain as drains
from fpindex.operators import duplicates as dups
from fpindex.operators import generate as gen
from fpindex.operators import lookup, pending, rehash, status, upkeep, verify
from fpindex.operators import paths as resolving
from fpindex.operators import rules as ruling
from fpindex.plans.api import FingerprintIndex
from fpindex.plans.fixtures import NOW, RULES, Fixture
from fpindex.sources import inventory, metadata, reports, store
from fpindex.session import cut_lineage, ensure_checkpoint_dir
from fpindex.sources import rules as rule_sources
from fpindex.sources.versions import VersionedStore
from fpindex.streaming import fold

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# sha1 of "The quick brown fox jumps over the lazy dog.", in no table
ABSENT = "408d94384216f890ff7a0c3528e8bed1e0b01621"


def query(function: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    QUERIES[function.__name__.rstrip("_")] = lambda spark, sf_dir: function(Fixture(spark, sf_dir))
    return function


def _joined(array: str, element=lambda x: x.cast("string")):
    return F.array_join(F.transform(array, element), ",")


def _top_hash(fx: Fixture, algo: str):
    """The most frequent hash of an algorithm, as a scalar."""
    groups = dups.duplicate_groups(fx.index(algo), algo)
    return groups.orderBy(*dups.group_order()).limit(1).select("hash_value").scalar()


# -- duplicates ----------------------------------------------------------------


@query
def duplicate_groups(fx):
    return dups.duplicate_groups(fx.index("sha1", "md5", "sha256"))


@query
def duplicate_members(fx):
    return dups.duplicate_members(fx.index("sha1", "md5", "sha256"))


@query
def duplicate_groups_page(fx):
    return dups.page(dups.duplicate_groups(fx.index("sha1")), limit=25, offset=10)


@query
def duplicate_group_lists(fx):
    nested = dups.nest_members(dups.duplicate_members(fx.index("sha1")))
    return nested.select(
        *dups.KEYS,
        "file_count",
        "part",
        _joined("files", lambda f: f["file_id"].cast("string")).alias("file_ids"),
    )


@query
def duplicates_with_paths(fx):
    return dups.duplicates_with_paths(fx.index("sha1"), fx.files, fx.storages)


@query
def duplicates_user(fx):
    groups = dups.visible_groups(fx.index("sha1"), fx.files, fx.storages, user="src8")
    return dups.page(groups, limit=500)


@query
def duplicates_user_files(fx):
    return dups.duplicates_with_paths(fx.index("sha1"), fx.files, fx.storages, user="src8")


@query
def duplicates_json(fx):
    members = dups.duplicates_with_paths(fx.index("sha1"), fx.files, fx.storages)
    return reports.duplicates_to_json(members)


@query
def duplicates_text(fx):
    members = dups.duplicates_with_paths(fx.index("sha1"), fx.files, fx.storages)
    return reports.duplicates_to_lines(members)


@query
def prefix_collisions(fx):
    # full hashes of one source differ in their last character only, so that there is something to find
    index = fx.documents.select(
        F.col("doc_id").alias("file_id"),
        F.lit("sha256").alias("algo"),
        F.concat(F.substring(F.sha2("source", 256), 1, 63), F.substring(F.sha2("text", 256), 64, 1)).alias("hash"),
    )
    return dups.prefix_collisions(index.unionByName(fx.index("sha1", "md5", "sha256")))


@query
def same_hash(fx):
    return dups.same_hash(fx.index("sha1", "md5", "sha256"), fx.state)


@query
def same_hash_user(fx):
    return dups.same_hash_with_paths(
        fx.index("sha1", "md5", "sha256"), fx.state, fx.files, fx.storages, user="src8"
    )


@query
def same_hash_of(fx):
    """Neighbours of the first file of the largest group."""
    index = fx.index("sha1", "md5", "sha256")
    largest = dups.duplicate_groups(index, "sha1").orderBy(*dups.group_order()).first()
    return dups.same_hash_of(index, largest["first_file_id"] if largest else -1)


@query
def same_hash_counts(fx):
    return dups.same_hash_counts(fx.index("sha1", "md5", "sha256"))


# -- lookups -------------------------------------------------------------------


@query
def lookup_by_hash(fx):
    index = fx.index("sha1", "md5", "sha256")
    return lookup.find_by_hash(
        index, fx.files, fx.storages, _top_hash(fx, "sha1"), limit=500
    )


@query
def lookup_absent_hash(fx):
    return lookup.find_by_hash(fx.index("sha1", "md5", "sha256"), fx.files, fx.storages, ABSENT)


@query
def lookup_by_algo_hash(fx):
    index = fx.index("sha1", "md5", "sha256")
    return lookup.filter_hash(index, _top_hash(fx, "md5"), "MD5")


@query
def lookup_user_scoped(fx):
    probes = fx.index("sha1").select("hash")
    return lookup.find_by_hashes(
        fx.index("sha1"), fx.files, fx.storages, probes, user="src8"
    )


@query
def lookup_long_hash(fx):
    full = metadata.import_eav_full(fx.eav, fx.metadata_documents)
    return full.filter(F.length("hash") > 63)


@query
def lookup_batch(fx):
    probes = metadata.import_packed(fx.files).select("hash", "algo")
    return lookup.find_by_hashes(
        fx.index("sha1", "md5", "sha256"), fx.files, fx.storages, probes
    )


@query
def search_terms(fx):
    return lookup.search_terms(fx.index("sha1", "md5", "sha256"), fx.files, fx.storages, fx.terms)


@query
def search_terms_user(fx):
    return lookup.search_terms(
        fx.index("sha1", "md5", "sha256"), fx.files, fx.storages, fx.terms, user="src8"
    )


@query
def parse_terms(fx):
    return lookup.parse_terms(fx.terms)


@query
def parse_terms_strict(fx):
    return lookup.parse_terms(fx.terms, strict=True)


@query
def scan_like(fx):
    return fx.files.filter(F.contains("checksum", _top_hash(fx, "sha1"))).select(
        "fileid", "path", "checksum"
    )


# -- listings ------------------------------------------------------------------


@query
def hashes_by_file(fx):
    return lookup.hashes_by_file(fx.recorded, fx.state)


@query
def hashes_for_user(fx):
    return lookup.hashes_for_user(fx.recorded, fx.state, fx.files, fx.storages, "src8")


@query
def hashes_by_path(fx):
    wanted = fx.documents.select(
        F.concat(F.lit("files/"), "lang", F.lit("/doc_"), F.col("doc_id"), F.lit(".pdf")).alias("path"),
        "source",
    ).select("path", F.col("source").alias("owner"))
    found = resolving.files_by_path(fx.files, fx.storages, wanted, by_user=True)
    return lookup.hashes_by_file(fx.recorded, fx.state, found.select("fileid")).join(
        found, "fileid"
    )


@query
def hash_count_per_file(fx):
    return lookup.hash_count_per_file(fx.files, fx.recorded)


@query
def resolve_paths(fx):
    return resolving.resolve_paths(fx.files, fx.storages)


@query
def owner_from_storage(fx):
    return fx.storages.select("id", paths.owner_from_storage(F.col("id")).alias("owner"))


@query
def users_in_scope(fx):
    users = [
        resolving.users_in_scope(fx.storages, scope).select(F.lit(scope).alias("scope"), "user")
        for scope in ("all", "src8", "nobody")
    ]
    return users[0].unionByName(users[1]).unionByName(users[2])


@query
def relative_paths(fx):
    return fx.files.select(
        "fileid",
        paths.relative_path(F.col("path"), F.lit("files/en/")).alias("below_en"),
        paths.relative_path(F.concat(F.lit("/"), "path"), F.lit("files")).alias("outside"),
        paths.relative_path(F.col("path"), F.col("path")).alias("itself"),
    )


@query
def scan_inventory(fx):
    return inventory.scan_inventory(fx.files)


@query
def walk_stats(fx):
    return gen.walk_stats(fx.owned_files, ["sha1", "md5"], "*.[mt]*", by=["owner"])


# -- codecs --------------------------------------------------------------------


@query
def parse_checksums(fx):
    pairs = F.inline_outer(codec.packed_pairs(F.col("checksum")))
    return fx.files.select("fileid", pairs).filter("algo IS NOT NULL")


@query
def parse_checksums_filtered(fx):
    packed = F.concat(F.col("checksum"), F.lit(" md5:later broken a:b:c"))
    return fx.files.select(
        "fileid",
        F.element_at(codec.parse_checksums(packed, ["MD5"]), "md5").alias("md5"),
        F.size(codec.parse_checksums(packed)).cast("long").alias("algos"),
        codec.malformed_pairs(packed).alias("malformed"),
    ).filter("algos >= 0")


@query
def pack_checksums(fx):
    hashes = F.create_map(
        F.lit("sha3-256"), F.sha2("text", 256),
        F.lit("sha512"), F.concat(F.sha2("text", 256), F.sha2("text", 256)),
        F.lit("sha256"), F.sha2("text", 256),
        F.lit("md5"), F.md5("text"),
        F.lit("sha1"), F.sha1("text"),
    )
    return fx.documents.select("doc_id", codec.pack_checksums(hashes).alias("packed"))


@query
def pack_keep_additional(fx):
    new = F.array(
        F.struct(F.lit("sha1").alias("algo"), F.sha1("path").alias("hash")),
        F.struct(F.lit("sha256").alias("algo"), F.sha2("path", 256).alias("hash")),
    )
    return fx.files.select(
        "fileid",
        codec.rewrite_packed(new, F.col("checksum"), keep_additional=True).alias("kept"),
        codec.rewrite_packed(new, F.col("checksum")).alias("replaced"),
    )


@query
def packed_mirror(fx):
    return store.with_packed_mirror(fx.files, fx.recorded, keep_additional=True).select(
        "fileid", "checksum"
    )


@query
def copy_checksums(fx):
    copies = fx.events.filter(F.col("kind") == "copied")
    return pending.copy_checksums(fx.files, copies)


@query
def copy_chains(fx):
    """Checksums after all copies in order; a copy of a copy takes what its source had then."""
    return copying.copies_in_order(fx.files, fx.events.filter(F.col("kind") == "copied"))


@query
def sync_legacy(fx):
    return pending.sync_from_packed(fx.files, fx.recorded)


@query
def missing_hashes(fx):
    missing = gen.missing_hashes(fx.files, ["sha1", "SHA256", "md5"])
    return missing.select("file_id", F.array_join("missing", ",").alias("missing"))


@query
def algo_normalize(fx):
    texts = fx.documents.select(
        "doc_id",
        F.when(F.col("lang") == "en", " All ")
        .when(F.col("lang") == "de", F.concat(F.lit("SHA1, md5,,"), F.col("source"), F.lit(", sha1 ")))
        .otherwise(F.concat(F.col("source"), F.lit(",MD5,"), F.upper("source")))
        .alias("listed"),
    )
    return texts.select(
        "doc_id",
        F.array_join(codec.normalize_algo_list(F.col("listed")), ",").alias("algos"),
        F.array_join(codec.supported_only(codec.normalize_algo_list(F.col("listed"))), ",").alias(
            "supported"
        ),
    )


@query
def pending_modes(fx):
    markers = fx.eav.filter(F.col("meta_key") == "file-checksum-updated_at")
    return markers.select(
        "file_id", codec.parse_mode(F.col("meta_value_string")).alias("mode")
    )


@query
def json_import(fx):
    return metadata.import_json(fx.metadata_documents)


@query
def json_authoritative(fx):
    found = metadata.extract_authoritative(F.col("json"), F.lit("file-checksum-md5"))
    return fx.metadata_documents.select("file_id", found["algo"].alias("algo"), found["hash"].alias("hash"))


@query
def json_export(fx):
    return metadata.export_json(fx.recorded.filter(F.col("algo") != "md5"), fx.state)


@query
def json_quarantine(fx):
    return metadata.quarantine_json(fx.metadata_documents)


@query
def packed_quarantine(fx):
    broken = fx.files.withColumn(
        "checksum", F.when(F.col("path").endswith(".md"), F.concat("checksum", F.lit(" x y:z:1 FOO:1"))).otherwise(F.col("checksum"))
    )
    return metadata.quarantine_packed(broken)


@query
def eav_import(fx):
    return metadata.import_eav(fx.eav, fx.metadata_documents)


@query
def eav_quarantine(fx):
    return metadata.quarantine_eav(fx.eav, fx.metadata_documents)


@query
def packed_dropped(fx):
    index = digests.digests_long(fx.documents, "doc_id", "text", ["sha1", "md5", "sha256"])
    return metadata.packed_dropped(index, max_bytes=120)


@query
def eav_state_import(fx):
    return metadata.import_eav_state(fx.eav)


@query
def eav_export(fx):
    return metadata.export_eav(fx.recorded, fx.state)


@query
def packed_export(fx):
    return metadata.export_packed(fx.recorded)


@query
def status_json(fx):
    return status.status_json(fx.files, fx.recorded, fx.state)


# -- globs and rules -----------------------------------------------------------


@query
def glob_filter(fx):
    url = F.col("url")
    return fx.table("pages").select(
        "page_id",
        globs.glob_match(url, "http*://*.example.[cno]*/*").alias("any_site"),
        globs.glob_match(url, "https://*").alias("secure"),
        globs.glob_match(url, "*/[!ef]?/*[0-9]").alias("plain_de"),
        globs.glob_match(url, "*\\?page=?&*").alias("paged"),
        globs.glob_match(url, "*.html").alias("html"),
    )


@query
def glob_search(fx):
    return gen.glob_search(fx.files, "files/*/doc_*[02468].pdf").select("fileid", "path")


@query
def glob_search_limit(fx):
    return gen.glob_search(fx.files, "files/[!e]*/doc_*.??", limit=50).select("fileid", "path")


@query
def rule_prefix(fx):
    globbed = F.concat(F.col("url"), F.lit("/*.txt"))
    return fx.table("pages").select("page_id", paths.rule_folder(globbed).alias("folder"))


@query
def rules_import(fx):
    return rule_sources.read_rules(fx.settings).select(
        "doc_id",
        "priority",
        "id",
        "enabled",
        "mode",
        F.array_join("algos", ",").alias("algos"),
        "path",
        "user_scope",
    )


@query
def rules_validate(fx):
    return rule_sources.validate_rules(rule_sources.read_rules(fx.settings)).select(
        "doc_id", "priority", F.array_join("algos", ",").alias("algos"), "valid"
    )


@query
def string_list_import(fx):
    texts = fx.documents.select(
        "doc_id",
        F.when(F.col("lang") == "de", F.lit('["a",'))
        .otherwise(F.concat(F.lit('["'), "source", F.lit('","",7,null,"'), "lang", F.lit('"]')))
        .alias("json"),
    )
    return texts.select(
        "doc_id", F.array_join(rule_sources.read_string_list(F.col("json")), ",").alias("items")
    )


@query
def first_matching_rule(fx):
    return ruling.match_rules(fx.owned_files, RULES).select("fileid", "rule_id", "rule_mode")


@query
def evaluate_rules(fx):
    return ruling.evaluate_rules(fx.owned_files, RULES, fx.state)


@query
def evaluate_rules_totals(fx):
    return ruling.rule_totals(ruling.evaluate_rules(fx.owned_files, RULES, fx.state))


@query
def evaluate_rules_capped(fx):
    evaluated = ruling.evaluate_rules(fx.owned_files, RULES, fx.state)
    return ruling.cap_marks(evaluated, 100).select("file_id", "rule_id", "mode")


@query
def process_rule(fx):
    return ruling.process_rule(fx.owned_files, RULES, fx.state, "r3")


# -- SQL functions -------------------------------------------------------------


@query
def sql_functions(fx):
    register_functions(fx.documents.sparkSession)
    packed = "concat('SHA1:', sha1(text), ' MD5:', md5(text))"
    return fx.documents.selectExpr(
        "doc_id",
        "content_digest(CAST(text AS BINARY), 'SHA256') AS sha256",
        "content_digest(CAST(text AS BINARY), 'whirlpool') AS unknown",
        "glob_match(concat('files/', lang, '/', source), '**/e?/src*') AS matches",
        f"parse_checksums({packed})['md5'] AS parsed",
        "pack_checksums(map('md5', md5(text), 'sha1', sha1(text))) AS packed",
        "parse_hash_term(concat('no term ', md5(text))).hash AS no_term",
        "parse_hash_term(concat('sha1:', upper(sha1(text)))).hash AS term",
    )


# -- queue and hashing ---------------------------------------------------------


@query
def stale_files(fx):
    return ruling.stale_files(fx.files, fx.state)


@query
def seed_pending(fx):
    return pending.seed_pending(fx.files, fx.state)


@query
def mark_pending(fx):
    marks = gen.mark_matching(fx.owned_files, "files/en/**")
    return pending.mark_pending(fx.state, marks)


@query
def clear_hashes(fx):
    gone = fx.state.filter("pending_mode = 'force'").select("file_id")
    return pending.clear_index(fx.recorded, gone)


@query
def clear_state(fx):
    gone = fx.files.filter(F.col("path").endswith(".md")).select(F.col("fileid").alias("file_id"))
    return pending.clear_state(fx.state, gone)


@query
def pending_batch(fx):
    return pending.pending_batch(fx.state, 50)


@query
def pending_stats(fx):
    return pending.pending_stats(fx.state)


@query
def needed_hashes(fx):
    return rehash.needed_hashes(fx.files, fx.recorded, fx.state)


@query
def recalc_existing(fx):
    results = rehash.recalc_existing(
        fx.files, fx.recorded.filter(F.col("algo") != "sha1"), fx.state, fx.content
    )
    return results.select("file_id", "algo", "success", "hash", "existed", "error")


@query
def generate_missing(fx):
    return gen.generate_missing(
        fx.owned_files, fx.recorded, fx.state, fx.content, ["sha1", "md5"], "*.[pt]*"
    )


@query
def generate_totals(fx):
    return gen.generate_totals(generate_missing(fx))


@query
def generate_budget(fx):
    return gen.candidates(fx.owned_files, ["sha1", "sha256"], "*.[pt]*", budget=100).select(
        "fileid", "owner"
    )


@query
def glob_search_page(fx):
    """The third page of a search that goes on where the page before ended."""
    last = None
    for _ in range(2):
        last = gen.glob_search_page(fx.files, "*[02468].[pm]*", 40, last).agg(F.max("fileid")).first()[0]
    return gen.glob_search_page(fx.files, "*[02468].[pm]*", 40, last).select("fileid", "path", "has_more")


@query
def generate_mark(fx):
    return gen.mark_matching(fx.owned_files, "*.pdf", scope="src8")


@query
def rehash_(fx):
    wanted = fx.files.select(F.col("fileid").alias("file_id"))
    return rehash.rehash(
        rehash.request_all(wanted, ["sha1", "MD5", "sha256"]),
        fx.files,
        fx.recorded,
        fx.state,
        fx.content,
        ["sha1", "md5", "sha256"],
    )


def _api(fx: Fixture) -> FingerprintIndex:
    return FingerprintIndex(fx.files, fx.storages, fx.recorded, fx.state, fx.content, RULES)


@query
def recalc_user(fx):
    """Hashes of all files as one user asks for them; files of others are not found."""
    wanted = fx.files.select(F.col("fileid").alias("file_id"))
    return _api(fx).recalc(wanted, ["sha1", "sha256"], user="src8")


@query
def verified_report(fx):
    """Duplicate groups with paths, each member checked against its content."""
    return _api(fx).verified_report("sha1")


def _drain_view(outcome: DataFrame) -> DataFrame:
    return outcome.select(
        "file_id",
        "pending_mode",
        "mode",
        "success",
        "updated_at",
        "next_pending",
        "computed",
        F.size("hashes").cast("long").alias("hash_count"),
        F.try_element_at("hashes", F.lit("sha1")).alias("sha1"),
        F.try_element_at("hashes", F.lit("md5")).alias("md5"),
        F.try_element_at("hashes", F.lit("sha256")).alias("sha256"),
    )


@query
def drain_pending(fx):
    return _drain_view(
        drains.drain(fx.state, fx.owned_files, fx.recorded, RULES, fx.content, NOW)
    )


@query
def drain_totals(fx):
    return drains.drain_totals(
        drains.drain(fx.state, fx.owned_files, fx.recorded, RULES, fx.content, NOW)
    )


@query
def rebuild(fx):
    return _drain_view(
        drains.rebuild(fx.owned_files, fx.state, fx.recorded, RULES, fx.content, NOW)
    )


def _stored(fx: Fixture) -> VersionedStore:
    """A new store with the tables, in the folder that the cluster shares."""
    store = VersionedStore(fx.spark, f"{ensure_checkpoint_dir(fx.spark).rstrip('/')}/stores/{uuid.uuid4().hex}")
    upkeep.create_store(store, fx.owned_files, fx.state, fx.recorded, buckets=8)
    return store


def _drained_store(fx: Fixture) -> VersionedStore:
    """A store after its queue was worked off once."""
    store = _stored(fx)
    files, state, index = (store.read(t) for t in ("files", "state", "index"))
    upkeep.commit_outcome(store, drains.drain(state, files, index, RULES, fx.content, NOW))
    return store


@query
def drain_twice(fx):
    """What a second drain finds: the files that failed, marked again."""
    store = _drained_store(fx)
    files, state, index = (store.read(t) for t in ("files", "state", "index"))
    return _drain_view(drains.drain(state, files, index, RULES, fx.content, NOW + 60))


@query
def groups_after_drain(fx):
    """Duplicate groups from the kept counts, after a drain changed some."""
    groups = _drained_store(fx).read("groups")
    return groups.filter((F.col("file_count") >= 2) & F.col("algo").isin("sha1", "md5", "sha256"))


@query
def kept_groups_page(fx):
    """A page of groups that reads the kept counts."""
    return upkeep.kept_page(_stored(fx), limit=25, offset=10)


# -- verification --------------------------------------------------------------


def _verified_groups(fx: Fixture) -> DataFrame:
    members = dups.duplicate_members(fx.recorded, "sha1")
    return verify.verify_groups(verify.verify_members(members, fx.content, ["sha1"]))


@query
def verify_duplicates(fx):
    return _verified_groups(fx)


@query
def verify_members(fx):
    members = dups.duplicate_members(fx.recorded, "sha1")
    return verify.verify_members(members, fx.content, ["sha1"])


@query
def verified_only(fx):
    return verify.verified_only(_verified_groups(fx))


@query
def matching_only(fx):
    unchecked = dups.duplicate_groups(fx.recorded, "md5").select(
        *dups.KEYS,
        "file_count",
        F.lit(None).cast("long").alias("match_count"),
        F.lit(None).cast("long").alias("mismatch_count"),
    )
    return verify.matching_only(_verified_groups(fx).unionByName(unchecked))


# -- events --------------------------------------------------------------------


@query
def event_fold(fx):
    events = fold.locate_events(fx.events, fx.owned_files)
    folded = fold.fold_events(events, RULES)
    return fold.apply_fold(fx.state, fx.recorded, folded, upsert=True)


# -- digests -------------------------------------------------------------------


@query
def digest_sha256(fx):
    return digests.digests_long(fx.documents, "doc_id", "text", ["sha256"])


@query
def digest_native(fx):
    return digests.digests_long(fx.documents, "doc_id", "text", ["sha1", "md5", "sha256"])


@query
def digest_all(fx):
    """All digests; those that SQL engines lack by length and by the first file with the same."""
    index = cut_lineage(digests.digests_long(fx.documents, "doc_id", "text", ALGOS))
    first = index.groupBy("algo", "hash").agg(F.min("file_id").alias("first_file_id"))
    known = F.col("algo").isin("sha1", "md5", "sha256", "adler32", "crc32")
    return index.join(first, ["algo", "hash"]).select(
        "file_id", "algo", F.when(known, F.col("hash")).alias("hash"),
        F.length("hash").cast("long").alias("digits"), "first_file_id",
    )


@query
def digest_checksums(fx):
    return digests.digests_long(fx.documents, "doc_id", "text", ["adler32", "crc32"])


@query
def digest_groups(fx):
    """Groups by each of the digests that SQL engines lack, named by a common one."""
    index = digests.digests_long(
        fx.documents, "doc_id", "text", ["sha512", "sha3-256", "sha3-512"]
    )
    return dups.duplicate_groups(index).drop("hash_value")


@query
def digest_invalid_algo(fx):
    wanted = fx.files.select(F.col("fileid").alias("file_id"))
    return rehash.rehash(
        rehash.request_all(wanted, ["whirlpool", "sha256"]),
        fx.files,
        fx.recorded,
        fx.state,
        fx.content,
        ["sha256"],
        skip_existing=False,
    )
