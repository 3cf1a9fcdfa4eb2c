"""The driver's tables seen as the tables of this engine.

``documents`` plays the file store (text as content), ``labels`` names the files
that are tracked already, ``events`` the file events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.functions.digests import digests_long
from fpindex.operators.paths import with_owner
from fpindex.operators.rules import Rule

NOW = 1735689600
BASE_TIME = 1704067200

RULES = (
    Rule("r0", "**/*.jpg", enabled=False),
    Rule("r1", "files/en/**", mode="force", algos=("sha256",)),
    Rule("r2", "**/*.pdf", user_scope="src8", mode="lazy", algos=("sha1",)),
    Rule("r3", "*[13579].txt", mode="missing", algos=("sha1", "md5")),
    Rule("r4", "**", mode="auto"),
)


# Schemas of the driver tables in use, so that opening one reads no footers.
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
    "pages": "page_id long, url string, html string",
}


class Fixture:
    """Views over one directory of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def files(self) -> DataFrame:
        return self.documents.select(
            F.col("doc_id").alias("fileid"),
            F.substring("source", 4, 20).cast("long").alias("storage"),
            F.expr(
                "concat('files/', lang, '/doc_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf'"
                " WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '.jpg' END)"
            ).alias("path"),
            F.expr(
                "concat('doc_', doc_id, CASE doc_id % 4 WHEN 0 THEN '.pdf'"
                " WHEN 1 THEN '.txt' WHEN 2 THEN '.md' ELSE '.jpg' END)"
            ).alias("name"),
            F.col("n_chars").alias("size"),
            (BASE_TIME + F.col("doc_id") * 60).alias("mtime"),
            F.expr(
                "CASE WHEN doc_id % 3 <> 0 THEN concat('SHA1:', sha1(text), ' MD5:', md5(text)) END"
            ).alias("checksum"),
        )

    @cached_property
    def storages(self) -> DataFrame:
        return (
            self.documents.select("source")
            .distinct()
            .select(
                F.substring("source", 4, 20).cast("long").alias("numeric_id"),
                "source",
            )
            .select(
                "numeric_id",
                F.when(F.col("numeric_id") % 5 == 0, F.concat(F.lit("local::/mnt/data/"), "source"))
                .when(F.col("numeric_id") % 7 == 3, F.concat(F.lit("object::store:"), "source"))
                .otherwise(F.concat(F.lit("home::"), "source"))
                .alias("id"),
            )
        )

    @cached_property
    def owned_files(self) -> DataFrame:
        return with_owner(self.files, self.storages)

    @cached_property
    def state(self) -> DataFrame:
        labelled = self.table("labels").join(self.documents.select("doc_id", "lang"), "doc_id")
        return labelled.select(
            F.col("doc_id").alias("file_id"),
            (BASE_TIME + F.col("doc_id") * 60 + F.when(F.col("quality") == 1, 10).otherwise(-10))
            .cast("long")
            .alias("updated_at"),
            F.when(F.col("toxic") == 1, "force")
            .when(F.col("quality") == 0, "new")
            .when(F.col("lang") == "de", "auto")
            .when(F.col("lang") == "fr", "missing")
            .when(F.col("lang") == "es", "lazy")
            .alias("pending_mode"),
        )

    def index(self, *algos: str) -> DataFrame:
        return digests_long(self.documents, "doc_id", "text", algos or ("sha1", "md5", "sha256"))

    @cached_property
    def recorded(self) -> DataFrame:
        """An index with gaps: md5 is lacking for one language, sha256 for short texts."""
        entries = F.filter(
            F.array(
                F.struct(F.lit("sha1").alias("algo"), F.sha1("text").alias("hash")),
                F.struct(
                    F.lit("md5").alias("algo"),
                    F.when(F.col("lang") != "de", F.md5("text")).alias("hash"),
                ),
                F.struct(
                    F.lit("sha256").alias("algo"),
                    F.when(F.col("n_chars") > 1000, F.sha2("text", 256)).alias("hash"),
                ),
            ),
            lambda e: e["hash"].isNotNull(),
        )
        return self.documents.select(F.col("doc_id").alias("file_id"), F.inline_outer(entries))

    @cached_property
    def content(self) -> DataFrame:
        """Contents as they are now: one storage was edited, one cannot be read."""
        return self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.when(F.col("source") == "src3", F.concat("text", F.lit(" (edited)")))
            .when(F.col("source") == "src7", None)
            .otherwise(F.col("text"))
            .alias("content"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            "event_id",
            "ts",
            F.expr(
                "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'written'"
                " WHEN 'purchase' THEN 'copied' WHEN 'error' THEN 'deleted' ELSE 'metadata' END"
            ).alias("kind"),
            F.col("user_id").alias("file_id"),
            F.when(F.col("event_type") == "purchase", F.col("user_id") + 1).alias("source_file_id"),
        )

    @cached_property
    def eav(self) -> DataFrame:
        """The legacy key/value index, foreign keys included."""
        hashes = self.recorded.select(
            "file_id",
            F.concat(F.lit("file-checksum-"), "algo").alias("meta_key"),
            F.substring("hash", 1, 63).alias("meta_value_string"),
            F.lit(None).cast("long").alias("meta_value_int"),
        )
        markers = self.state.select(
            "file_id",
            F.lit("file-checksum-updated_at").alias("meta_key"),
            F.concat(F.lit("pending:"), "pending_mode").alias("meta_value_string"),
            F.col("updated_at").alias("meta_value_int"),
        )
        foreign = self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.lit("photos-size").alias("meta_key"),
            F.lit(None).cast("string").alias("meta_value_string"),
            F.col("n_chars").alias("meta_value_int"),
        )
        return hashes.unionByName(markers).unionByName(foreign)

    @cached_property
    def metadata_documents(self) -> DataFrame:
        """One JSON document per file: object, bare and array entries, some broken."""
        return self.documents.select(
            F.col("doc_id").alias("file_id"),
            F.when(
                F.col("lang") == "es",
                F.concat(F.lit('{"file-checksum-sha1":"'), F.sha1("text")),
            )
            .when(F.col("lang") == "fr", "")
            .otherwise(
                F.concat(
                    F.lit('{"file-checksum-sha1":{"value":"'),
                    F.sha1("text"),
                    F.lit('","type":"string","etag":"","indexed":true,"editPermission":0},'),
                    F.lit('"file-checksum-md5":"'),
                    F.md5("text"),
                    F.lit('","file-checksum-sha256":{"value":"'),
                    F.sha2("text", 256),
                    F.lit('","type":"string"},"file-checksum-updated_at":{"value":'),
                    F.col("n_chars").cast("string"),
                    F.lit(',"type":"int"},"photos-size":{"value":3,"type":"int"}}'),
                )
            )
            .alias("json"),
        )

    @cached_property
    def terms(self) -> DataFrame:
        """Search terms of all kinds, one per document."""
        return self.documents.select(
            F.when(F.col("lang") == "en", F.concat(F.lit("sha1:"), F.sha1("text")))
            .when(F.col("lang") == "de", F.upper(F.md5("text")))
            .when(F.col("lang") == "fr", F.concat(F.lit("SHA256: "), F.sha2("text", 256)))
            .otherwise(F.concat(F.lit("  sha3-256:"), F.sha2("text", 256)))
            .alias("term")
        )

    @cached_property
    def settings(self) -> DataFrame:
        """One rule setting per document: arrays, an object and broken text."""
        return self.documents.select(
            "doc_id",
            F.when(
                F.col("lang") == "en",
                F.concat(
                    F.lit('[{"id":"a'),
                    F.col("doc_id").cast("string"),
                    F.lit('","enabled":true,"mode":"force","algos":["sha256","nope"],"path":"'),
                    F.col("source"),
                    F.lit('/**","userScope":"'),
                    F.col("source"),
                    F.lit('"},{"id":"b","enabled":false,"path":"/","algos":["nope"]}]'),
                ),
            )
            .when(F.col("lang") == "de", F.concat(F.lit('[{"id":"'), F.col("source")))
            .when(F.col("lang") == "fr", F.lit('{"id":"x","enabled":true}'))
            .otherwise(F.concat(F.lit('[{"id":"'), F.col("source"), F.lit('","enabled":1,"path":""}]')))
            .alias("json"),
        )
