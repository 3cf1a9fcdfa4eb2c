"""WARC archives: one gzip member per record, written and read by tasks.

A page becomes a ``response`` record whose block is an HTTP header and the
payload, or a ``revisit`` record, which has the HTTP header alone and refers to
the record with the same payload. The header of a revisit keeps the length and
the digest of the full payload.

A task writes files of bounded size under names that no other attempt uses,
and reports them when they are complete; the table of reported files is the
archive. What a lost task leaves is in no table.

Reading goes through a file once, from its start: compressed bytes are fed to
zlib piece by piece, a record's header names the length of its block, and the
block is hashed as it arrives. A record is never held unless its payload is
asked for.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.constants import HOT_GROUP_ROWS
from fpindex.operators.joins import join_groups

RESPONSE, REVISIT = "response", "revisit"
#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
#: A file is closed when it has so many bytes.
FILE_BYTES = 256 << 20
#: Bytes read at once, and rows handed on at once.
READ_BYTES, ROWS = 1 << 20, 2000
#: Tasks that read archives, at most.
MOST_READERS = 20_000
#: The longest record or HTTP header that is accepted.
HEADER_BYTES = 1 << 20
# Fixed values of WARC/1.1
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"
END = b"\r\n\r\n"

_RECORD = "urn:page:"
_READ = (
    "path string, offset long, record_type string, page_id {id}, refers_to {id}, url string,"
    " payload_bytes long, payload_digest string, payload binary, error string"
)


def planned_records(
    pages: DataFrame,
    least: int = LEAST_REVISIT,
    id: str = "page_id",
    url: str = "url",
    html: str = "html",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """``page_id, url, sha1, payload_bytes, payload, refers_to``; the last is null for responses.

    Of the rows with equal payloads of at least ``least`` bytes those with the
    smallest id are responses (one, unless the id is repeated), and the others
    refer to it. A null id is never the smallest if there is another; a null
    payload is an empty one.

    Payloads are grouped by digests and lengths. Only those of responses are
    shuffled, by digest and id, so that no key is frequent; revisits are rows
    without payload, and their groups are cut into parts of ``hot_rows`` rows.
    """
    rows = pages.select(
        F.col(id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("payload")
    )
    rows = rows.select(
        "page_id", "url", F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("check"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), "payload",
    )
    keys = ["sha1", "check", "payload_bytes"]
    none = F.lit(None).cast(rows.schema["page_id"].dataType)
    small = rows.filter(F.col("payload_bytes") < least).withColumn("refers_to", none)
    large = rows.filter(F.col("payload_bytes") >= least)
    groups = large.groupBy(*keys).agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    group = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "first")
    same = F.col("page_id").eqNullSafe(F.col("first"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    responses = large.join(group, same, "left_semi").withColumn("refers_to", none)
    shared = groups.filter("n > 1 AND first IS NOT NULL")
    revisits = (
        join_groups(large.withColumn("payload", F.lit(None).cast("binary")), shared, keys, "n", "page_id", hot_rows)
        .filter(~F.col("page_id").eqNullSafe(F.col("first")))
        .withColumn("refers_to", F.col("first"))
    )
    names = ["page_id", "url", "sha1", "payload_bytes", "payload", "refers_to"]
    return responses.select(*names).unionByName(revisits.select(*names)).unionByName(small.select(*names))


def _escaped(url: str) -> str:
    """A url without white space and control characters, which would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record(page_id, url: str | None, payload: bytes, size: int, sha1: str, refers_to, date: str) -> bytes:
    """One record, uncompressed; ``size`` and ``sha1`` are those of the full payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {size}\r\n\r\n"
    ).encode()
    block = http + payload if refers_to is None else http
    lines = [
        f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}",
        f"WARC-Record-ID: <{_RECORD}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(sha1))}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_escaped(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_RECORD}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return b"\r\n".join([VERSION, *(line.encode() for line in lines), b"", block]) + END


def _member(data: bytes, level: int) -> bytes:
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def _writing(root: str, date: str, level: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = fs.FileSystem.from_uri(root)
        stream, name, size, n = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            stream.close()
            return pa.RecordBatch.from_pydict({"file": [name], "bytes": [size], "records": [n]})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                if stream is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = system.open_output_stream(f"{folder}/{name}", compression=None)
                data = _member(record(*(c[i].as_py() for c in columns), date), level)
                stream.write(data)
                size, n = size + len(data), n + 1
                if size >= file_bytes:
                    yield closed()
                    stream = None
        if stream is not None:
            yield closed()

    return write


def write_warc(
    records: DataFrame, path: str, date: str, level: int = 6, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write :func:`planned_records` below ``path``; ``(file, bytes, records)`` of the files.

    ``path`` is a folder that driver and executors share, as a URI. The list of
    complete files is stored there too, in ``files``; :func:`read_warc` goes by it.
    """
    spark = records.sparkSession
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    system, folder = fs.FileSystem.from_uri(root)
    system.create_dir(f"{folder}/data", recursive=True)
    rows = records.select("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to")
    rows.mapInArrow(
        _writing(f"{root}/data", date, level, file_bytes), "file string, bytes long, records long"
    ).write.parquet(f"{root}/files")
    return spark.read.parquet(f"{root}/files")


class BrokenRecord(ValueError):
    """What is wrong with a record."""


class _Record:
    """A record that arrives in pieces: its header, then as many bytes as the header says."""

    def __init__(self, keep: bool) -> None:
        self._keep, self._head, self._http = keep, bytearray(), bytearray()
        self.fields: dict[str, str] | None = None
        self._left, self._tail, self._in_http = 0, bytearray(), True
        self._block, self._payload = hashlib.sha1(), hashlib.sha1()
        self._size, self._parts = 0, []

    def feed(self, data: bytes) -> None:
        if self.fields is None:
            # the end of the header may be cut by the end of a piece
            seen = max(0, len(self._head) - len(END) + 1)
            self._head += data
            at = self._head.find(END, seen)
            if at < 0:
                if len(self._head) > HEADER_BYTES:
                    raise BrokenRecord("header too long")
                return
            data = bytes(self._head[at + len(END) :])
            self._begin(bytes(self._head[:at]))
        body, rest = data[: self._left], data[self._left :]
        self._left -= len(body)
        self._block.update(body)
        self._content(body)
        self._tail += rest
        if len(self._tail) > len(END):
            raise BrokenRecord("block longer than Content-Length")

    def _begin(self, head: bytes) -> None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise BrokenRecord("no WARC version line")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length = self.fields.get("content-length", "")
        if not length.isdigit():
            raise BrokenRecord("no Content-Length")
        self._left, self._head = int(length), bytearray()
        self._in_http = self.fields.get("content-type", "").startswith("application/http")

    def _content(self, data: bytes) -> None:
        if self._in_http:
            seen = max(0, len(self._http) - len(END) + 1)
            self._http += data
            at = self._http.find(END, seen)
            if at < 0:
                if len(self._http) > HEADER_BYTES:
                    raise BrokenRecord("HTTP header too long")
                return
            data = bytes(self._http[at + len(END) :])
            del self._http[at:]
            self._in_http = False
        self._size += len(data)
        self._payload.update(data)
        if self._keep and data:
            self._parts.append(data)

    def _digest(self, name: str, made: bytes) -> None:
        told = self.fields.get(name)
        if told is not None and told.partition(":")[0].lower() == "sha1":
            if told.partition(":")[2].upper() != base32(made):
                raise BrokenRecord(f"{name} does not match")

    def done(self) -> dict:
        """What the complete record says; its digests are checked."""
        if self.fields is None or self._left or bytes(self._tail) != END:
            raise BrokenRecord("record ends early")
        kind = self.fields.get("warc-type")
        self._digest("warc-block-digest", self._block.digest())
        told = self.fields.get("warc-payload-digest", "")
        if kind == REVISIT:
            # the payload is with the record referred to; the HTTP header tells its length
            http = bytes(self._http).decode("latin-1").lower().split("\r\n")
            length = [line.partition(":")[2].strip() for line in http if line.startswith("content-length:")]
            size = int(length[0]) if length and length[0].isdigit() else None
            digest = told.partition(":")[2].upper() or None
        else:
            self._digest("warc-payload-digest", self._payload.digest())
            size, digest = self._size, base32(self._payload.digest())
        return {
            "record_type": kind,
            "page_id": _page(self.fields.get("warc-record-id")),
            "refers_to": _page(self.fields.get("warc-refers-to")),
            "url": self.fields.get("warc-target-uri"),
            "payload_bytes": size,
            "payload_digest": digest,
            "payload": b"".join(self._parts) if self._keep and kind != REVISIT else None,
            "error": None,
        }


def _page(name: str | None) -> str | None:
    """The page id in a record's name, null for other names."""
    inner = (name or "").removeprefix("<").removesuffix(">")
    return (inner[len(_RECORD) :] or None) if inner.startswith(_RECORD) else None


def _next_member(file, at: int) -> int | None:
    """Where gzip's first bytes stand next, from ``at`` on."""
    file.seek(at)
    data = b""
    while more := file.read(READ_BYTES):
        data += more
        found = data.find(GZIP_MAGIC)
        if found >= 0:
            return at + found
        kept = min(len(data), len(GZIP_MAGIC) - 1)
        at, data = at + len(data) - kept, data[len(data) - kept :]
    return None


def read_records(file, keep: bool = False) -> Iterator[tuple[int, dict]]:
    """``(offset, fields)`` of every gzip member of a file, in order.

    A member that cannot be inflated, is cut off, holds anything but one whole
    record or has a wrong digest gives a row with ``error``. Reading goes on at
    the next first bytes of a member; if those do not begin a record (they may
    stand anywhere in compressed data), they are passed over.
    """
    data, at, lost = file.read(READ_BYTES), 0, False  # ``at`` is the offset of data[0]
    while data:
        start, inflate, item, fields = at, zlib.decompressobj(31), _Record(keep), None
        try:
            while not inflate.eof:
                made = inflate.decompress(data, READ_BYTES)
                item.feed(made)
                rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                at, data = at + len(data) - len(rest), rest
                if not data and not inflate.eof and len(made) < READ_BYTES:
                    data = file.read(READ_BYTES)
                    if not data:
                        raise BrokenRecord("file ends within a record")
            fields = item.done()
        except (zlib.error, BrokenRecord) as problem:
            if not lost or item.fields is not None:
                yield start, {"error": str(problem)}
            lost, next_ = True, _next_member(file, start + 1)
            if next_ is None:
                return
            file.seek(next_)
            at, data = next_, file.read(READ_BYTES)
            continue
        lost = False
        yield start, fields
        data = data or file.read(READ_BYTES)


def _reading(keep: bool, schema: pa.Schema):
    def rows(paths: list[str]) -> Iterator[dict]:
        for path in paths:
            try:
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    for offset, fields in read_records(file, keep):
                        for name in ("page_id", "refers_to"):
                            if fields.get(name) is not None and schema.field(name).type != pa.string():
                                fields[name] = int(fields[name])
                        yield {"path": path, "offset": offset, **fields}
            except (OSError, pa.ArrowException) as problem:
                yield {"path": path, "error": str(problem)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for row in rows(batch.column(0).to_pylist()):
                waiting.append(row)
                size += len(row.get("payload") or b"")
                if len(waiting) >= ROWS or size >= READ_BYTES * 8:
                    yield pa.RecordBatch.from_pylist(waiting, schema=schema)
                    waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, schema=schema)

    return run


def read_warc(files: DataFrame, payloads: bool = False, id: str = "long") -> DataFrame:
    """Records of the archives ``files(path)``, each read by one task from start to end.

    ``(path, offset, record_type, page_id, refers_to, url, payload_bytes,
    payload_digest, payload, error)``: ``payload`` is null unless asked for and
    for revisits. Responses were checked against their digests; a record that
    is broken has ``error`` and its offset, and hides no other record.
    """
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kind = kinds[id]
    names = ["path", "offset", "record_type", "page_id", "refers_to", "url"]
    types = [pa.string(), pa.int64(), pa.string(), kind, kind, pa.string()]
    names += ["payload_bytes", "payload_digest", "payload", "error"]
    types += [pa.int64(), pa.string(), pa.binary(), pa.string()]
    # a path each: files are dealt out evenly, and adaptive execution does not merge their tasks
    dealt = files.select("path").coalesce(1).repartition(max(1, min(files.count(), MOST_READERS)))
    return dealt.mapInArrow(_reading(payloads, pa.schema(list(zip(names, types)))), _READ.format(id=id))


def written_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` of every complete file below a folder of :func:`write_warc`."""
    root = path if "://" in path or path.startswith("file:") else f"file://{path}"
    return spark.read.parquet(f"{root}/files").select(F.concat(F.lit(f"{root}/data/"), "file").alias("path"))
