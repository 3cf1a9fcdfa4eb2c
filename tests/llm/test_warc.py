import base64
import gzip
import hashlib
import io

import pytest

from fpindex.llm.warc import _member, planned_records, read_records, read_warc, record, write_warc, written_files

DATE = "2024-01-01T00:00:00Z"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@pytest.fixture
def hard_pages(spark):
    """Copies, nulls everywhere, empty and long pages, repeated ids and rows, clashing names."""
    long = "".join(f"<p>{i} é</p>" for i in range(200_000))
    rows = [
        (5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "x", "<p>same</p>"),
        (4, "http://c/ d\r\nX: 1", ""), (6, "", None), (7, "http://e/é", long), (8, "u", long), (10, "v", "\r\n\r\n"),
        (11, "w", "twice"), (11, "w", "twice"), (12, "w", "twice"), (None, "n", "no id"), (None, "n", "no id"), (-2, "m", "\x00 "),
    ]
    table = [(*r, "a", 1) for r in rows]
    return spark.createDataFrame(table, "page_id long, url string, html string, payload string, `first` int")


def expected(rows, least):
    out = []
    for r in rows:
        body = (r.html or "").encode()
        ids = [x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None]
        first = min(ids, default=None)
        refers = first if len(body) >= least and first is not None and r.page_id != first else None
        out.append((r.page_id, len(body), digest(body), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, file_bytes, hot_rows", [(0, 1 << 28, 2), (6, 500, 1000), (1 << 40, 1, 1)])
def test_pages_come_back(spark, tmp_path, hard_pages, least, file_bytes, hot_rows):
    write_warc(planned_records(hard_pages, least, hot_rows=hot_rows), str(tmp_path / "w"), DATE, file_bytes=file_bytes)
    read = read_warc(written_files(spark, str(tmp_path / "w")), payloads=True).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str)
    rows = hard_pages.collect()
    assert all(r.error is None for r in read)
    assert got == expected(rows, least)
    texts = {(r.page_id, (r.html or "").encode()) for r in rows}
    assert all((r.page_id, bytes(r.payload)) in texts for r in read if r.record_type == "response")
    urls = {r.page_id: r.url for r in read}
    assert urls[9] is None and urls[6] == "" and urls[7] == "http://e/é" and urls[4] == "http://c/%20d%0D%0AX:%201"


def test_no_pages(spark, tmp_path, hard_pages):
    write_warc(planned_records(hard_pages.filter("false")), str(tmp_path / "w"), DATE)
    assert read_warc(written_files(spark, str(tmp_path / "w"))).count() == 0


def test_files_have_a_gzip_member_per_record(spark, tmp_path, hard_pages):
    files = write_warc(planned_records(hard_pages), str(tmp_path / "w"), DATE).collect()
    assert sum(f.records for f in files) == 15
    for f in files:
        path = tmp_path / "w" / "data" / f.file
        assert path.stat().st_size == f.bytes
        with open(path, "rb") as file:
            offsets = [at for at, _ in read_records(file)]
        data = path.read_bytes()
        assert len(offsets) == f.records
        for a, b in zip(offsets, [*offsets[1:], len(data)]):
            one = gzip.decompress(data[a:b])
            head, _, block = one.partition(b"\r\n\r\n")
            length = int(head.split(b"\r\nContent-Length: ")[1].split(b"\r\n")[0])
            assert one.startswith(b"WARC/1.1\r\n") and block[length:] == b"\r\n\r\n"


def test_files_that_nobody_reported_are_not_read(spark, tmp_path, hard_pages):
    write_warc(planned_records(hard_pages), str(tmp_path / "w"), DATE)
    (tmp_path / "w" / "data" / "left-behind.warc.gz").write_bytes(b"half a file")
    assert read_warc(written_files(spark, str(tmp_path / "w"))).count() == 15


def one(i, body=b"<p>text</p>" * 9):
    return _member(record(i, "u", body, len(body), hashlib.sha1(body).hexdigest(), None, DATE), 6)


def test_broken_records_hide_no_others():
    members = [one(i, bytes(str(i), "ascii") * 3000) for i in range(6)]
    flipped = bytearray(members[1])
    flipped[len(flipped) // 2] ^= 255
    plain = gzip.decompress(members[3]).replace(b"33333", b"33433", 1)  # digests do not fit any more
    short = gzip.compress(gzip.decompress(members[4])[:-9])
    data = b"".join([members[0], bytes(flipped), members[2], gzip.compress(plain), short, members[5], members[0][:50]])
    found = [f for _, f in read_records(io.BytesIO(data))]
    assert [f.get("page_id") for f in found] == ["0", None, "2", None, None, "5", None]
    errors = [f.get("error") for f in found]
    assert errors[0] is errors[2] is errors[5] is None
    assert errors[3].endswith("does not match") and errors[4] == "record ends early" and errors[6] == "file ends within a record"


def test_records_over_many_reads(monkeypatch):
    from fpindex.llm import warc

    monkeypatch.setattr(warc, "READ_BYTES", 7)
    bodies = [b"", b"\r\n\r\n" * 20, b"a" * 5000, bytes(range(256)) * 9]
    data = b"".join(one(i, b) for i, b in enumerate(bodies))
    got = [f for _, f in read_records(io.BytesIO(data), keep=True)]
    assert [(f["error"], f["payload"], f["payload_digest"]) for f in got] == [(None, b, digest(b)) for b in bodies]
    noise = b"noise" + data
    found = [f for _, f in read_records(io.BytesIO(noise))]
    assert found[0]["error"] and [f["page_id"] for f in found[1:]] == ["0", "1", "2", "3"]


def test_unreadable_files_are_rows(spark):
    rows = read_warc(spark.createDataFrame([("file:///nowhere/x.warc.gz",)], "path string")).collect()
    assert len(rows) == 1 and rows[0].error and rows[0].path == "file:///nowhere/x.warc.gz"
