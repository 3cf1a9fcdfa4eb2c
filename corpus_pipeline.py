"""From documents to token ids: clean, deduplicated and decontaminated.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents that it
keeps, with their columns; the last one adds token ids. Between two stages the
documents are written and read again.

Rows are judged one by one; a row whose text is null or empty has no near
duplicate and no benchmark passage, is not toxic unless texts without words
are, and is rejected by the language stage. Rows that repeat an id and a text
are copies of each other. Columns beyond those of ``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fpindex.llm import langid, toxicity
from fpindex.llm.decontaminate import find_leaks
from fpindex.llm.neardup import near_duplicates
from fpindex.llm.pieces import encode
from fpindex.llm.scratch import Scratch

#: A document is toxic from this score on.
TOXIC_SCORE = 0.5
#: A document is dropped if its main language has less than this share of its letters.
LANGUAGE_SHARE = 0.4


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with lines before them until no column of ``docs`` has them."""
    lines = "_" * (1 + max((len(c) for c in docs.columns), default=0))
    return [lines + n for n in names]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity score; learnt from all labels of documents that are there."""
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score_column(docs, model) < TOXIC_SCORE)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, most of them in one of the languages of the corpus."""
    found = langid.language_column(docs, langid.fit(docs))
    kept = (found["lang_pred"] != langid.UNDETERMINED) & (found["score"] >= LANGUAGE_SHARE)
    return docs.filter(kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, once."""
    judged = near_duplicates(docs, words=5, percent=80)
    id, key, text_key, turn = _names(docs, "id", "key", "text_key", "turn")
    # rows that share an id may be in one group; it needs one of them. Rows without a group, of which there
    # may be any number, are dealt by their ids
    alone = F.when(F.col("group_key").isNull(), F.xxhash64("doc_id", "text_key"))
    first = F.row_number().over(Window.partitionBy("group_key", alone).orderBy("text_key"))
    kept = judged.filter("kept").withColumn("turn", first)
    kept = kept.filter("turn = 1 OR group_key IS NULL").select("doc_id", "text_key").distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id)) & (F.col(text_key) == F.col(key))
    joined = docs.withColumn(text_key, F.xxhash64("text")).join(kept.toDF(id, key), same, "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", text_key).orderBy(F.lit(0)))
    return joined.withColumn(turn, once).filter(F.col(turn) == 1).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is nearly a benchmark item."""
    leaks = find_leaks(docs, _read(spark, sf_dir, "benchmark"), words=5, percent=80)
    id, key = _names(docs, "id", "key")
    same = F.col("doc_id").eqNullSafe(F.col(id)) & (F.xxhash64("text") == F.col(key))
    return docs.join(leaks.select("doc_id", "text_key").distinct().toDF(id, key), same, "left_anti")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text."""
    coded = encode(docs, out="pieces", round_trip="round_trip")
    return coded.withColumn("n_pieces", F.size("pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pieces", encode_pieces),
]

#: The trained stages are beyond SQL. Tests compare toxicity, near duplicates, decontamination and pieces with plain
#: loops over planted rows; the language stage by what it keeps and drops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
