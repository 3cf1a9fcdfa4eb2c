"""Documents that hold benchmark items, found by the shingles they share.

A window as long as an item, in words, is similar to it by the weighted Jaccard
similarity of their shingles. A window that reaches the similarity holds one of
the item's rarest shingles, as many of them as it may lose and one more; so
these name the pairs of document and item. Each shingle that they share counts
for a run of window starts, and the sums over these runs are the exact common
weights of all windows of a pair. Nothing is estimated and no pair is lost. All
of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fpindex.llm.scratch import Scratch

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BITS = 64
#: Up to so many shingles of items (some 100 MB) are broadcast; beyond, shuffled.
BROADCAST_SHINGLES = 2_000_000


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null gives none."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingled(hashes: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order, with repetitions."""
    return F.when(
        F.size(hashes) >= k,
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - k),
            lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]),
        ),
    ).otherwise(F.array().cast("array<long>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set if it is set in more than half of the word hashes."""

    def bit(b: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), b)
        ones = F.aggregate(
            hashes, F.lit(0), lambda s, x: s + F.when(x.bitwiseAND(mask) != 0, 1).otherwise(0)
        )
        return F.when(ones * 2 > F.size(hashes), mask).otherwise(F.lit(0).cast("long"))

    return F.aggregate(
        F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit),
        F.lit(0).cast("long"),
        lambda a, x: a.bitwiseOR(x),
    )


def blocks(fingerprint: Column, radius: int) -> Column:
    """One number per block, with the number of the block in it."""
    n = radius + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return F.array(
        *[
            F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) * n + i
            for i, (a, b) in enumerate(zip(edges, edges[1:]))
        ]
    )


def _shingles_by_length(hashes: Column, lengths: list[int]) -> Column:
    """Shingles of ``k`` words, for rows with any ``k`` of ``lengths``."""
    found = F.lit(None).cast("array<long>")
    for k in lengths:
        found = F.when(F.col("k") == k, shingled(hashes, k)).otherwise(found)
    return found


def _telling(shingles: DataFrame, percent: int) -> DataFrame:
    """``k, shingle, item``: the rarest shingles of each item, one more than a similar window may lose."""
    spread = shingles.groupBy("k", "shingle").agg(F.count("*").alias("items"))
    # a window that reaches ``percent`` holds ``percent`` of the item's shingles at least
    least = F.ceil(F.col("n_shingles") * percent / 100)
    before = F.sum(F.size("places")).over(
        Window.partitionBy("item").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = shingles.join(spread, ["k", "shingle"]).withColumn("before", F.coalesce(before, F.lit(0)))
    return ranked.filter(F.col("before") <= F.col("n_shingles") - least).select("k", "shingle", "item")


def _windows(hits: DataFrame, shingles: DataFrame, percent: int, small: bool) -> DataFrame:
    """``doc, item, start, common, aligned, all``: common weight of windows from ``start`` on.

    ``hits`` are the places of items' shingles in documents. Weights change at
    the starts listed only. At an ``aligned`` start a shingle stands at the
    same place in window and item.
    """
    near = F.broadcast if small else lambda df: df
    pairs = hits.join(near(_telling(shingles, percent)), ["k", "shingle"]).select("doc", "k", "item").distinct()
    shared = (
        pairs.join(hits, ["doc", "k"])
        .join(near(shingles), ["k", "item", "shingle"])
        .groupBy("doc", "item", "k", "shingle")
        .agg(
            F.sort_array(F.collect_set("p")).alias("at"),
            *[F.first(c).alias(c) for c in ("places", "n_words", "n_shingles", "n_doc")],
        )
    )
    pair = Window.partitionBy("doc", "item")
    most = F.sum(F.least(F.size("at"), F.size("places"))).over(pair)
    last = F.greatest(F.lit(0), F.col("n_doc") - F.col("n_words"))
    either = F.least("n_doc", "n_words") - F.col("k") + 1 + F.col("n_shingles")

    def change(start: Column, by: int, aligned: int) -> Column:
        return F.struct(start.cast("int").alias("start"), F.lit(by).alias("by"), F.lit(aligned).alias("aligned"))

    # a place counts in windows that reach it, up to that of as many places of its shingle as the item has
    begins = F.transform(
        "at",
        lambda p, i: change(
            F.greatest(
                F.lit(0),
                p - F.col("n_shingles") + 1,
                F.coalesce(F.get("at", i - F.size("places")) + 1, F.lit(0)),
            ),
            1,
            0,
        ),
    )
    ends = F.transform("at", lambda p: change(p + 1, -1, 0))
    aligned = F.array_distinct(
        F.flatten(
            F.transform(
                "at",
                lambda p: F.transform("places", lambda q: change(F.greatest(F.lit(0), F.least(p - q, last)), 0, 1)),
            )
        )
    )
    return (
        shared.withColumns({"most": most, "last": last, "all": either})
        .filter(F.col("most") * 100 >= (F.col("all") - F.col("most")) * percent)
        .select("doc", "item", "all", "last", F.explode(F.concat(begins, ends, aligned)).alias("change"))
        .select("doc", "item", "all", "last", "change.*")
        .filter(F.col("start") <= F.col("last"))
        .groupBy("doc", "item", "start", "all")
        .agg(F.sum("by").alias("by"), F.max("aligned").alias("aligned"))
        .withColumn("common", F.sum("by").over(pair.orderBy("start")))
    )


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    words: int = 5,
    percent: int = 80,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """``doc_id, text_key, item_id, start, n_words, similarity`` of leaked items.

    One row per document and item whose best window reaches ``percent``: its
    first word, and the weighted Jaccard similarity of the shingles. Of equally
    similar windows those come first in which a shingle stands at its place in
    the item, then the first. An item of fewer than ``words`` words is one
    shingle. Null, empty or blank texts hold nothing, and such items are
    nowhere. Repeated rows and items give one row per id, text and item. Other
    columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    n = F.size("hashes")
    prepared = (
        items.select(F.col(item_id).alias("item_id"), hashed(words_of(F.col(item_text))).alias("hashes"))
        .filter(n > 0)
        .withColumns({"n_words": n, "k": F.least(n, F.lit(words)), "item": F.xxhash64("hashes")})
    )
    lengths = sorted(r["k"] for r in prepared.select("k").distinct().collect())
    # items of one text are looked for once
    ids = prepared.select("item_id", "item", "n_words").distinct()
    shingles = scratch.store(
        prepared.dropDuplicates(["item"])
        .select("k", "item", "n_words", F.posexplode(_shingles_by_length(F.col("hashes"), lengths)).alias("q", "shingle"))
        .groupBy("k", "item", "n_words", "shingle")
        .agg(F.sort_array(F.collect_list("q")).alias("places"))
        .withColumn("n_shingles", F.col("n_words") - F.col("k") + 1)
    )
    small = shingles.count() <= broadcast_shingles
    hashed_docs = docs.select(
        F.struct(F.col(id).alias("doc_id"), F.xxhash64(text).alias("text_key")).alias("doc"),
        hashed(words_of(F.col(text))).alias("hashes"),
    )
    known = shingles.select("k", "shingle").distinct()
    hits = None
    for k in lengths or [words]:
        mine = known.filter(F.col("k") == k)
        part = hashed_docs.select(
            "doc", n.alias("n_doc"), F.posexplode(shingled(F.col("hashes"), k)).alias("p", "shingle")
        ).join(F.broadcast(mine) if small else mine, "shingle")
        hits = part if hits is None else hits.unionByName(part)
    windows = _windows(scratch.store(hits), shingles, percent, small)
    return (
        windows.filter(F.col("common") * 100 >= (F.col("all") - F.col("common")) * percent)
        .groupBy("doc", "item", "all")
        .agg(F.max(F.struct("common", "aligned", (-F.col("start")).alias("s"))).alias("best"))
        .join(F.broadcast(ids) if small else ids, "item")
        .withColumn("similarity", F.col("best.common") / (F.col("all") - F.col("best.common")))
        .groupBy("doc", "item_id")
        .agg(F.max(F.struct("similarity", "best.s", F.col("n_words").alias("n"))).alias("best"))
        .select(
            "doc.doc_id",
            "doc.text_key",
            "item_id",
            (-F.col("best.s")).alias("start"),
            F.col("best.n").alias("n_words"),
            F.col("best.similarity").alias("similarity"),
        )
    )
