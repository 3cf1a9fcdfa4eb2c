import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fpindex.constants import ALGOS, HEX_LENGTH
from fpindex.functions import codec, paths
from fpindex.functions.sql import register_functions
from fpindex.functions.terms import parse_hash_term


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def text(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(
    "packed, algos, expected",
    [
        ("SHA1:abc123 MD5:def456", None, {"sha1": "abc123", "md5": "def456"}),
        ("SHA1:abc123 MD5:def456 SHA256:ghi789", ["sha1", "sha256"], {"sha1": "abc123", "sha256": "ghi789"}),
        (None, None, {}),
        ("", None, {}),
        ("SHA1:a  SHA1:b", None, {"sha1": "b"}),
        ("nocolon A:b:c MD5:x", None, {"md5": "x"}),
    ],
)
def test_parse_checksums(spark, packed, algos, expected):
    assert one(spark, codec.parse_checksums(text(packed), algos)) == expected


def test_malformed_pairs_are_counted(spark):
    assert one(spark, codec.malformed_pairs(text("nocolon A:b:c MD5:x"))) == 2


def test_keep_additional(spark):
    new = F.array(
        F.struct(F.lit("sha1").alias("algo"), F.lit("new456").alias("hash")),
        F.struct(F.lit("md5").alias("algo"), F.lit("added789").alias("hash")),
    )
    old = text("SHA1:old123 SHA256:keep456")
    assert one(spark, codec.rewrite_packed(new, old, True)) == "SHA1:new456 MD5:added789 SHA256:keep456"
    assert one(spark, codec.rewrite_packed(new, old)) == "SHA1:new456 MD5:added789"


def test_packing_skips_what_does_not_fit(spark):
    hashes = F.create_map(*[F.lit(x) for a in ALGOS for x in (a, "0" * HEX_LENGTH[a])])
    packed = one(spark, codec.pack_checksums(hashes))
    assert [p.split(":")[0] for p in packed.split(" ")] == ["SHA1", "MD5", "ADLER32", "CRC32", "SHA256"]
    assert len(packed) == 186


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(ALGOS[:5]), st.text("0123456789abcdef", min_size=1, max_size=64)))
def test_pack_parse_round_trip(spark, hashes):
    entries = [F.lit(x) for kv in hashes.items() for x in kv]
    column = F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")
    packed = codec.pack_checksums(column)
    pairs = one(spark, packed)
    kept = {p.split(":")[0].lower(): p.split(":")[1] for p in pairs.split(" ") if p}
    assert len(pairs) <= 255
    assert kept.items() <= hashes.items()
    assert one(spark, codec.parse_checksums(packed)) == kept


@pytest.mark.parametrize(
    "term, algo, value",
    [
        ("1a2b3c4d", None, "1a2b3c4d"),
        ("a" * 128, None, "a" * 128),
        ("sha256:abcdef1234567890abcdef1234567890abcdef12", "sha256", "abcdef1234567890abcdef1234567890abcdef12"),
        ("SHA3-256:1A2B3C4D", "sha3-256", "1a2b3c4d"),
    ],
)
def test_valid_terms(spark, term, algo, value):
    assert tuple(one(spark, parse_hash_term(text(term)))) == (algo, value)


@pytest.mark.parametrize("term", ["", "not-a-hash", "abc", "sha256:xyz", "a" * 129])
def test_invalid_terms(spark, term):
    assert one(spark, parse_hash_term(text(term))) is None


def test_strict_terms_know_fewer_prefixes(spark):
    assert one(spark, parse_hash_term(text("sha3-256:1a2b3c4d"), strict=True)) is None
    assert tuple(one(spark, parse_hash_term(text("md5:1a2b3c4d"), strict=True))) == ("md5", "1a2b3c4d")


@pytest.mark.parametrize("status, mode", [("pending:auto", "auto"), ("force", "force"), ("pending:", "")])
def test_parse_mode(spark, status, mode):
    assert one(spark, codec.parse_mode(text(status))) == mode


@pytest.mark.parametrize(
    "storage, owner",
    [("home::admin", "admin"), ("local::/mnt/data/user1", "user1"), ("local::/mnt/u/", "u"), ("object::x", "object::x")],
)
def test_owner(spark, storage, owner):
    assert one(spark, paths.owner_from_storage(text(storage))) == owner


@pytest.mark.parametrize(
    "path, base, expected",
    [("/a/b/c", "/a/", "b/c"), ("/a", "/a", ""), ("/ab/c", "/a", "ab/c"), ("//x", "/a", "x")],
)
def test_relative_path(spark, path, base, expected):
    assert one(spark, paths.relative_path(text(path), text(base))) == expected


@pytest.mark.parametrize(
    "glob, folder",
    [("", "/"), ("**", "/"), ("/", "/"), ("files/en/**", "/files/en"), ("/a/b*", "/a/b"), ("*.txt", "/"), (" x/{a} ", "/x")],
)
def test_rule_folder(spark, glob, folder):
    assert one(spark, paths.rule_folder(text(glob))) == folder


def test_times_are_utc_whatever_the_session_says(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, codec.iso8601(F.lit(0))) == "1970-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_missing_algos(spark):
    column = codec.missing_algos(text("SHA1:x md5 SHA256:"), ["sha1", "MD5", "sha256"])
    assert one(spark, column) == ["md5"]


def test_algo_lists(spark):
    assert one(spark, codec.normalize_algo_list(text(" ALL "))) == list(ALGOS)
    assert one(spark, codec.normalize_algo_list(text("SHA1, md5,,sha1,\tx "))) == ["sha1", "md5", "x"]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql(
        "SELECT content_digest(CAST('x' AS BINARY), 'SHA1') AS sha1,"
        " content_digest(CAST('The quick brown fox jumped over the lazy dog.' AS BINARY), 'crc32') AS crc,"
        " content_digest(CAST('x' AS BINARY), 'nope') AS nope,"
        " parse_checksums('SHA1:a bad SHA1:b') AS parsed,"
        " pack_checksums(map('md5', '1', 'sha1', '2')) AS packed,"
        " parse_hash_term('SHA1:1A2B3C4D') AS term,"
        " glob_match('a/b.txt', '*[!x].txt') AS hit"
    ).first()
    assert row["sha1"] == "11f6ad8ec52a2984abaafd7c3b516503785c2072"
    assert row["crc"] == "413a86af"
    assert row["nope"] is None
    assert row["parsed"] == {"sha1": "b"}
    assert row["packed"] == "SHA1:2 MD5:1"
    assert tuple(row["term"]) == ("sha1", "1a2b3c4d")
    assert row["hit"] is True
