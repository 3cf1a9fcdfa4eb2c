"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fpindex.functions.codec import let
from fpindex.llm.codes import vector_codes
from fpindex.llm.ctw import score_texts
from fpindex.llm.decontaminate import find_leaks
from fpindex.llm.langid import identify
from fpindex.llm.neardup import near_duplicates
from fpindex.llm.pieces import piece_summary
from fpindex.llm.runs import periodic_runs
from fpindex.llm.scratch import Scratch
from fpindex.llm.token_counts import line_sections, token_counts
from fpindex.llm.token_store import token_checksums, write_tokens
from fpindex.llm.topk import top_k
from fpindex.llm.toxicity import score_toxicity
from fpindex.llm.urls import judge_urls, parse_rule
from fpindex.llm.warc import planned_records, read_warc, write_warc, written_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on four-word shingles."""
    found = near_duplicates(_read(spark, sf_dir, "documents"), words=4, percent=80)
    return found.drop("text_key", "group_key")

#: The rules of the url query.
URL_RULES = [
    parse_rule("allow", "org/"),
    parse_rule("block", "example.org/es/"),
    parse_rule("block", "example.org/en/1"),
    parse_rule("allow", "com/fr/"),
    parse_rule("block", "com/de/"),
]


@query
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    path = Scratch(spark).path()
    write_tokens(_read(spark, sf_dir, "documents"), path)
    return token_checksums(spark, path)


@query
def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, decoded again."""
    return piece_summary(_read(spark, sf_dir, "documents"))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents."""
    docs = _read(spark, sf_dir, "documents")
    return token_counts(docs.withColumn("sections", line_sections(F.col("text"))), rule="most")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents."""
    leaks = find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return leaks.drop("text_key")


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages."""
    return judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


@query
def op10_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by context-tree weighting."""
    return score_texts(_read(spark, sf_dir, "documents"), folds=7, fold=2)


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    return score_toxicity(docs, labels, folds=5, held_out=0)


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents."""
    return identify(_read(spark, sf_dir, "documents"), folds=4, held_out=2)


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best inner products of every 50th vector against all others."""
    return top_k(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """Documents, of which one in ten repeats some of its words up to its end.

    With ``h`` the CRC-32 of the decimal id, texts of ``n`` words with ``h % 10 = 0``
    have word ``a + (i - a) % p`` in place of each word ``i`` from ``a`` on, where
    ``g = h / 10``, ``a = g % n`` and ``p = 1 + (n - a) / (3 + g % 8)``. A null id
    changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = lambda place: let(place[0], lambda a: let(place[1], lambda p: F.transform(
            w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int"))))))
        return F.when(n > 0, F.array_join(tail(F.array(a, p)), " ")).otherwise("")

    return docs.withColumn("text", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, one in ten of them with a repeated tail."""
    found = periodic_runs(with_repeated_tails(_read(spark, sf_dir, "documents")))
    key = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"], r["period"].alias("q")))
    best = F.array_max(key)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-best["col2"]).alias("start"),
        best["length"].alias("length"),
        best["q"].alias("period"),
        F.floor(1000 * best["length"] / best["q"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC archives and read back."""
    path = Scratch(spark).path()
    write_warc(planned_records(_read(spark, sf_dir, "pages")), path, date="2024-01-01T00:00:00Z")
    found = read_warc(written_files(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of 16 parts for all vectors, with codebooks of 64 entries moved twice."""
    return vector_codes(_read(spark, sf_dir, "embeddings")).drop("computed")
