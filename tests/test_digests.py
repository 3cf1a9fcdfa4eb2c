import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, ERR_NO_CONTENT, HEX_LENGTH
from fpindex.functions.digests import digests_long, hex_digests, with_digests
from fpindex.operators import asked
from fpindex.operators.asked import id_filter
from fpindex.operators.rehash import asked_contents, digest_plan, rehash, request_all
from fpindex.sources.content import StoredFiles, digest_stored
from fpindex.sources.inventory import read_contents, walk_files

FOX = b"The quick brown fox jumps over the lazy dog."

# Known digests of the empty text and of FOX.
GOLDEN = {
    "sha1": ("da39a3ee5e6b4b0d3255bfef95601890afd80709", "408d94384216f890ff7a0c3528e8bed1e0b01621"),
    "md5": ("d41d8cd98f00b204e9800998ecf8427e", "e4d909c290d0fb1ca068ffaddf22cbd0"),
    "adler32": ("00000001", "6be41008"),
    "crc32": ("00000000", "bd2cf7ab"),
    "sha256": (
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855",
        "ef537f25c895bfa782526529a9b63d97aa631564d5d789c2b765448c8635fb6c",
    ),
    "sha512": (
        "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e",
        "91ea1245f20d46ae9a037a989f54f1f790f0a47607eeb8a14d12890cea77a1bbc6c7ed9cf205e67b7f2b8fd4c7dfd3a7a8617e45f3c463d481c7e586c39ac1ed",
    ),
    "sha3-512": (
        "a69f73cca23a9ac5c8b567dc185a756e97c982164fe25859e0d1dcc1475c80a615b2123af1f5f94c11e3e9402c3ac558f500199d95b6d3e301758586281dcd26",
        "18f4f4bd419603f95538837003d9d254c26c23765565162247483f65c50303597bc9ce4d289f21d1c2f1f458828e33dc442100331b35e7eb031b5d38ba6460f8",
    ),
    "sha3-256": (
        "a7ffc6f8bf1ed76651c14756a061d662f580ff4de43b49fa82d80a4b80f8434a",
        "a80f839cd4f83f6c3dafc87feae470045e4eb0d366397d5c6ce34ba1739f734d",
    ),
}


def golden(algo, data):
    if algo in GOLDEN:
        return GOLDEN[algo][0 if data == b"" else 1]
    return hashlib.new(algo.replace("-", "_"), data).hexdigest()


def bitwise_crc(data):
    """CRC-32 with polynomial 04c11db7, most significant bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return (crc ^ 0xFFFFFFFF).to_bytes(4, "little").hex()


def test_golden_digests(spark):
    df = spark.createDataFrame([(0, bytearray(b"")), (1, bytearray(FOX))], "id long, content binary")
    found = {(r["file_id"], r["algo"]): r["hash"] for r in digests_long(df, "id", "content").collect()}
    assert found == {(i, a): golden(a, d) for i, d in enumerate((b"", FOX)) for a in ALGOS}
    assert all(len(h) == HEX_LENGTH[a] for (_, a), h in found.items())


def test_crc32_is_not_the_zlib_one():
    fox = b"The quick brown fox jumped over the lazy dog."
    assert hex_digests([fox], ["crc32"]) == ["413a86af"]
    assert f"{zlib.crc32(fox):08x}" == "82a34642"
    for data in (b"", b"123456789", bytes(range(256)) * 3):
        assert hex_digests([data[:5], data[5:]], ["crc32"]) == [bitwise_crc(data)]


def test_unknown_algorithms_are_refused(spark):
    with pytest.raises(ValueError):
        with_digests(spark.createDataFrame([("x",)], "c string"), "c", ["sha1", "nope"])


def test_python_digests_run_once(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = digests_long(documents, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    native = digests_long(documents, "doc_id", "text", ["sha1", "sha512"])
    assert "EvalPython" not in native._jdf.queryExecution().executedPlan().toString()


def test_only_what_is_needed_is_computed(spark):
    df = spark.createDataFrame(
        [(1, b"x", ["sha1", "crc32"]), (2, b"x", []), (3, None, ["md5"])],
        "file_id long, content binary, needed array<string>",
    )
    found = {r["file_id"]: r["digests"] for r in with_digests(df, "content", needed="needed").collect()}
    assert {k for k, v in found[1].items() if v} == {"sha1", "crc32"}
    assert not any(found[2].values()) and not any(found[3].values())


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "store"
    (root / "deep" / "er").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"")
    (root / "deep" / "b.txt").write_bytes(FOX)
    (root / "deep" / "er" / "big.bin").write_bytes(FOX * 100_000)
    return root


def test_walk_and_hash_a_tree(spark, tree):
    files = walk_files(spark, str(tree))
    found = {r["path"]: r["size"] for r in files.collect()}
    assert found == {"a.txt": 0, "deep/b.txt": 44, "deep/er/big.bin": 4_400_000}
    assert {r["path"] for r in walk_files(spark, str(tree), glob="deep/*.txt").collect()} == {"deep/b.txt"}

    stored = StoredFiles(files.select(F.col("fileid").alias("file_id"), "uri"), chunk_bytes=4096)
    ids = files.select(F.col("fileid").alias("file_id"))
    made = {r["file_id"]: r["digests"] for r in digest_stored(ids, stored).collect()}
    for row in files.collect():
        data = (tree / row["path"]).read_bytes()
        assert made[row["fileid"]] == dict(zip(ALGOS, hex_digests([data], ALGOS)))

    small = read_contents(spark, str(tree), max_bytes=1000)
    rows = digests_long(small, "file_id", "content", ["sha3-256"]).collect()
    assert {r["file_id"]: r["hash"] for r in rows} == {
        r["fileid"]: made[r["fileid"]]["sha3-256"] for r in files.collect() if 0 < r["size"] < 1000
    }
    named = read_contents(spark, str(tree), name_glob="*.bin")
    assert [r["uri"].rsplit("/", 1)[1] for r in named.select("uri").collect()] == ["big.bin"]


def test_unreadable_files_become_error_rows(spark, tree):
    files = walk_files(spark, str(tree)).select(
        "fileid", "mtime", F.lit(None).cast("string").alias("checksum"), "uri"
    )
    uris = files.select(
        F.col("fileid").alias("file_id"),
        F.when(F.col("uri").endswith("b.txt"), F.concat("uri", F.lit(".gone"))).otherwise(F.col("uri")).alias("uri"),
    )
    index = spark.createDataFrame([], "file_id long, algo string, hash string")
    state = spark.createDataFrame([], "file_id long, updated_at long, pending_mode string")
    wanted = request_all(files.select(F.col("fileid").alias("file_id")), ["sha1", "crc32"])
    results = rehash(wanted, files, index, state, StoredFiles(uris)).collect()
    assert len(results) == 6
    assert sorted(r["error"] for r in results if not r["success"]) == [ERR_NO_CONTENT] * 2


def content_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("file_id"), F.col("text").alias("content")
    )


@pytest.mark.parametrize("share", [1, 3, 50, 1000])
def test_plans_of_all_sizes_digest_what_they_ask_for(spark, sf_dir, rows, share):
    content = content_of(spark, sf_dir)
    algos = F.when(F.col("file_id") % 2 == 0, F.array(F.lit("md5"), F.lit("crc32"))).otherwise(F.array(F.lit("sha1")))
    plan = content.filter(F.col("file_id") % share == 0).select("file_id", algos.alias("needed"))
    asked = asked_contents(content, id_filter(plan, ALGOS, "needed"))
    assert rows(asked.select("file_id", F.sort_array("needed"))) == rows(plan.select("file_id", F.sort_array("needed")))
    made = digest_plan(plan, content, ["md5", "sha1", "crc32"])
    given = {r.file_id: {k: v for k, v in r.digests.items() if v} for r in made.collect()}
    texts = {r.file_id: r.content.encode() for r in content.collect()}
    for r in plan.collect():
        assert given[r.file_id] == dict(zip(r.needed, hex_digests([texts[r.file_id]], r.needed)))
    assert len(given) == plan.count()


def test_contents_do_not_cross_a_shuffle(spark, sf_dir):
    content = content_of(spark, sf_dir)
    plan = content.select("file_id", F.array(F.lit("md5")).alias("needed"))
    made = digest_plan(plan, content, ["md5"])
    text = made._jdf.queryExecution().executedPlan().toString()
    scanned = [line for line in text.splitlines() if "content" in line]
    assert scanned and not any("Exchange" in line for line in scanned)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    pushed = [x for x in made._jdf.queryExecution().explainString(mode).splitlines() if "PushedFilters" in x]
    assert any("GreaterThanOrEqual(doc_id,0), LessThanOrEqual(doc_id,199)" in x for x in pushed), pushed


def test_full_fields_only_cost_more(spark, monkeypatch):
    """A plan beyond the bound of the fields keeps all its rows and gets more of the others."""
    monkeypatch.setattr(asked, "LEAST_BITS", 1 << 15)
    monkeypatch.setattr(asked, "MOST_BITS", 1 << 15)
    plan = spark.range(0, 40_000, 2).select(F.col("id").alias("file_id"))
    table = spark.range(-5_000, 60_000).select(F.col("id").alias("file_id"))
    found = id_filter(plan)
    assert (found.parts, found.hashes) == (1, 1)
    kept = found.keep(table)
    assert kept.join(plan, "file_id", "left_semi").count() == 20_000
    assert 20_000 < kept.count() < 40_000 and kept.filter("file_id < 0 OR file_id > 39998").count() == 0


def test_filters_of_nothing_and_of_nulls(spark):
    ids = spark.createDataFrame([(None, ["a"]), (7, []), (9, None), (-3, ["b"])], "file_id long, needed array<string>")
    table = spark.createDataFrame([(None, 1), (7, 2), (9, 3), (-3, 4), (8, 5)], "file_id long, n int")
    assert [tuple(r) for r in id_filter(ids, ("a", "b"), "needed").asked(table).collect()] == [(-3, 4, ["b"])]
    assert sorted(r.file_id for r in id_filter(ids).keep(table).collect()) == [-3, 7, 9]
    assert id_filter(ids.filter("false")).keep(table).count() == id_filter(ids.filter("false"), ("a",), "needed").asked(table).count() == 0
