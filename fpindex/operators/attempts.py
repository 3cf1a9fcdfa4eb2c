"""Failed attempts: a file that cannot be hashed is tried again later and later.

``attempts(file_id, attempts, retry_at)`` has a row for every file whose last
drain failed. Its marker stays in the queue, and :func:`due_state` hides it
until its time has come. A success forgets the attempts; so does a new event of
the file, which marks it anew (:func:`without_attempts`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds before the first retry, and the most; each failure doubles the wait.
FIRST_WAIT, LONGEST_WAIT = 60, 86_400
ATTEMPTS = "file_id long, attempts int, retry_at long"


def wait_after(attempts: Column, first: int = FIRST_WAIT, longest: int = LONGEST_WAIT) -> Column:
    """Seconds to wait after so many failures."""
    doubled = F.lit(first) * F.pow(F.lit(2.0), F.least(attempts - 1, F.lit(40)))
    return F.least(doubled, F.lit(float(longest))).cast("long")


def next_attempts(
    attempts: DataFrame, outcome: DataFrame, now: int, first: int = FIRST_WAIT, longest: int = LONGEST_WAIT
) -> DataFrame:
    """Attempts after a drain: failures count one more, successes are forgotten, other files keep theirs."""
    known = attempts.select("file_id", "attempts", "retry_at")
    untouched = known.join(outcome.select("file_id"), "file_id", "left_anti")
    failed = outcome.filter("NOT success").select("file_id").join(known.select("file_id", "attempts"), "file_id", "left")
    n = (F.coalesce("attempts", F.lit(0)) + 1).cast("int")
    retried = failed.select("file_id", n.alias("attempts")).withColumn(
        "retry_at", F.lit(now) + wait_after(F.col("attempts"), first, longest)
    )
    return untouched.unionByName(retried)


def without_attempts(attempts: DataFrame, ids: DataFrame) -> DataFrame:
    """Attempts without those of files that were marked anew."""
    return attempts.join(ids.select("file_id"), "file_id", "left_anti")


def due_state(state: DataFrame, attempts: DataFrame, now: int) -> DataFrame:
    """State in which files whose time has not come are not in the queue."""
    later = attempts.filter(F.col("retry_at") > now).select("file_id", F.lit(True).alias("_later"))
    joined = state.select("file_id", "updated_at", "pending_mode").join(later, "file_id", "left")
    return joined.select(
        "file_id", "updated_at", F.when(F.col("_later").isNull(), F.col("pending_mode")).alias("pending_mode")
    )


def retry_stats(attempts: DataFrame, now: int) -> DataFrame:
    """Files by number of failed attempts, and how many of them are due."""
    return attempts.groupBy("attempts").agg(
        F.count("*").alias("files"), F.count_if(F.col("retry_at") <= now).alias("due"), F.min("retry_at").alias("next_at")
    )
