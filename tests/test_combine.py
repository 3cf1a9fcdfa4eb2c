import random

from pyspark.sql import functions as F

from fpindex.functions.combine import EMPTY, hex_checksums, joined, part_of
from fpindex.functions.digests import hex_digests
from fpindex.sources.content import StoredFiles, checksum_stored

BOTH = ("adler32", "crc32")


def test_parts_of_random_cuts_join_to_the_whole():
    rng = random.Random(2)
    for n in [0, 1, 2, 5, 1000, 70_000, 200_000]:
        data = rng.randbytes(n) if n != 70_000 else b"\xff" * n
        for _ in range(6):
            cuts = sorted(rng.randrange(n + 1) for _ in range(rng.randrange(5)))
            total = EMPTY
            for a, b in zip([0, *cuts], [*cuts, n]):
                total = joined(total, part_of([data[a:b]]))
            assert total.length == n and hex_checksums(total) == dict(zip(BOTH, hex_digests([data], BOTH)))


def test_stored_objects_by_ranges(spark, tmp_path):
    rng, rows = random.Random(3), []
    for i, n in enumerate([0, 1, 999, 1000, 1001, 25_500]):
        (tmp_path / f"f{i}").write_bytes(rng.randbytes(n))
        rows.append((i, f"file://{tmp_path}/f{i}"))
    rows.append((9, f"file://{tmp_path}/gone"))
    files = StoredFiles(spark.createDataFrame(rows, "file_id long, uri string"), chunk_bytes=300)
    plan = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 5, 9, 77)], "file_id long")
    got = {r.file_id: (r.digests, r.read_error is None) for r in checksum_stored(plan, files, range_bytes=1000).collect()}
    want = {i: (dict(zip(BOTH, hex_digests([(tmp_path / f"f{i}").read_bytes()], BOTH))), True) for i in range(6)}
    assert got == {**want, 9: (None, False)}
    assert checksum_stored(plan.filter(F.lit(False)), files).count() == 0
