"""Tables in versions: a write becomes visible as a whole or not at all.

A table is dealt over buckets by a hash of its key. A version is a small file
that names, for every table, the folder of each bucket. A commit writes new
folders for the buckets it changes, refers to the old ones for all others, and
publishes the version last, by a rename. Whoever is killed before leaves
folders that no version names; readers see the version before. Readers can ask
for any version that is still there; :meth:`VersionedStore.vacuum` removes old
ones by age.

    root/versions/0000000012.json     what version 12 consists of
    root/data/<table>/<write>/_bucket=<n>/part-….parquet

There is one writer at a time. Two that start from the same version do not both
succeed: the number of a version is taken once.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer published the version that this one was about to publish."""


@dataclass(frozen=True)
class Layout:
    """How a table is dealt and written: key columns, order within files, columns with a Bloom filter."""

    key: Sequence[str]
    order: Sequence[str] = ()
    bloom: Sequence[str] = ()


#: Layouts of the tables of a store; a hash equality reads few row groups of each bucket of the index.
LAYOUTS = {
    "state": Layout(("file_id",), ("file_id",)),
    "index": Layout(("file_id",), ("hash", "algo", "file_id"), ("hash",)),
    "files": Layout(("fileid",), ("fileid",)),
    "groups": Layout(("algo", "hash_value"), ("file_count",)),
    "attempts": Layout(("file_id",), ("file_id",)),
    "fold": Layout(("file_id",), ("file_id",)),
}


@dataclass(frozen=True)
class Change:
    """What a commit does to a table: ``rows`` of the buckets of ``touched`` keys become ``update(rows)``.

    All rows of the result have keys in those buckets.
    """

    touched: DataFrame
    update: Callable[[DataFrame], DataFrame]


class _Folder:
    """The few file operations on a shared folder that are no Spark jobs."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.root = root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, name: str) -> list[tuple[str, float]]:
        """Entries of a folder with the time they were changed."""
        place = self._at(name)
        if not self._fs.exists(place):
            return []
        return [(s.getPath().getName(), s.getModificationTime() / 1000) for s in self._fs.listStatus(place)]

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """Write a file under its final name at once; false if the name is taken."""
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        if self._fs.exists(self._at(name)):
            return False
        self._fs.mkdirs(self._at(name).getParent())
        # where a rename replaces what is there, the text tells who was last
        return bool(self._fs.rename(draft, self._at(name))) and self.read(name) == text

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass(frozen=True)
class Version:
    """A published version: folders by table and bucket, and what its writer noted."""

    number: int
    created: float
    tables: Mapping[str, Mapping[str, str]]
    schemas: Mapping[str, str]
    buckets: int
    notes: Mapping[str, object]


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


class VersionedStore:
    """Versioned tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, layouts: Mapping[str, Layout] = LAYOUTS) -> None:
        self.spark = spark
        self._folder = _Folder(spark, root)
        self._layouts = layouts

    # -- reading -------------------------------------------------------------

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n[:-5]) for n, _ in self._folder.names("versions") if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version | None:
        """The given version, or the last one; none of a new store."""
        numbers = self.numbers()
        if number is None:
            if not numbers:
                return None
            number = numbers[-1]
        elif number not in numbers:
            raise ValueError(f"no version {number}")
        return Version(**json.loads(self._folder.read(f"versions/{number:010d}.json"))["version"])

    def read(self, table: str, version: Version | int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of a table; with ``buckets`` those of some buckets, and no other file is opened."""
        if not isinstance(version, Version):
            version = self.version(version)
        if version is None or table not in version.schemas:
            raise ValueError(f"no table {table}")
        schema = T.StructType.fromJson(json.loads(version.schemas[table]))
        places = version.tables[table]
        wanted = places if buckets is None else [str(b) for b in buckets if str(b) in places]
        paths = [f"{self._folder.root}/data/{places[b]}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    # -- writing -------------------------------------------------------------

    def _write(self, table: str, rows: DataFrame, buckets: int, parts: int) -> dict[str, str]:
        """Folders of the buckets that have rows."""
        layout, name = self._layouts[table], f"{table}/{uuid.uuid4().hex}"
        dealt = rows.withColumn(_BUCKET, bucket_of(layout.key, buckets)).repartition(parts, _BUCKET)
        writer = dealt.sortWithinPartitions(_BUCKET, *layout.order).write.partitionBy(_BUCKET)
        for column in layout.bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(f"{self._folder.root}/data/{name}")
        found = [n for n, _ in self._folder.names(f"data/{name}") if n.startswith(f"{_BUCKET}=")]
        return {n.partition("=")[2]: f"{name}/{n}" for n in found}

    def _publish(self, number: int, tables, schemas, buckets: int, notes) -> Version:
        version = Version(number, time.time(), tables, schemas, buckets, notes)
        text = json.dumps({"write": uuid.uuid4().hex, "version": version.__dict__})
        if not self._folder.publish(f"versions/{number:010d}.json", text):
            raise Conflict(f"version {number} was published by another writer")
        return version

    def create(self, tables: Mapping[str, DataFrame], buckets: int = BUCKETS, notes: Mapping | None = None) -> Version:
        """The first version of a store."""
        if self.version() is not None:
            raise Conflict("the store has versions")
        placed = {name: self._write(name, df, buckets, buckets) for name, df in tables.items()}
        schemas = {name: df.schema.json() for name, df in tables.items()}
        return self._publish(1, placed, schemas, buckets, dict(notes or {}))

    def touched_buckets(self, table: str, version: Version, touched: DataFrame) -> list[int]:
        """Buckets that the keys of ``touched`` belong to; at most as many numbers as there are buckets."""
        key = bucket_of(self._layouts[table].key, version.buckets)
        return sorted(r[0] for r in touched.select(key.alias(_BUCKET)).distinct().collect())

    def commit(
        self, changes: Mapping[str, Change], notes: Mapping | None = None, base: Version | None = None
    ) -> Version:
        """The next version. Only touched buckets are read and written."""
        base = base or self.version()
        if base is None:
            raise ValueError("the store has no version yet")
        tables = {name: dict(places) for name, places in base.tables.items()}
        for name, change in changes.items():
            buckets = self.touched_buckets(name, base, change.touched)
            if not buckets:
                continue
            old = self.read(name, base, buckets)
            new = change.update(old).select(*old.columns)
            written = self._write(name, new, base.buckets, len(buckets))
            stray = set(written) - {str(b) for b in buckets}
            if stray:
                raise ValueError(f"rows of {name} outside the touched buckets")
            for b in buckets:
                tables[name].pop(str(b), None)
            tables[name] |= written
        return self._publish(base.number + 1, tables, base.schemas, base.buckets, {**base.notes, **(notes or {})})

    def vacuum(self, older_than: float, now: float | None = None) -> list[str]:
        """Remove versions older than so many seconds, and folders that only they name.

        The last version stays whatever its age, and so does what it names.
        Folders of no version go when they are that old themselves, so that
        writes under way keep theirs.
        """
        now = time.time() if now is None else now
        numbers = self.numbers()
        old = [n for n in numbers[:-1] if self.version(n).created < now - older_than]
        kept = [self.version(n) for n in numbers if n not in old]
        named = {p.rpartition("/")[0] for v in kept for places in v.tables.values() for p in places.values()}
        for n in old:
            self._folder.delete(f"versions/{n:010d}.json")
        removed = []
        for table, _ in self._folder.names("data"):
            for name, changed in self._folder.names(f"data/{table}"):
                if f"{table}/{name}" not in named and changed < now - older_than:
                    self._folder.delete(f"data/{table}/{name}")
                    removed.append(f"{table}/{name}")
        return removed
