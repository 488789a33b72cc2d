"""Equi-joins that survive one key holding a large share of the left side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.session import work_folder

ROWS_PER_TASK = 1 << 20
# A key below this share of all rows is never hot, so fewer keys than its inverse can be, however large the data is.
HOT_SHARE = 1 / 65536
NULL_SALTS = 65536


def key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows per key: a partial aggregate over the key columns alone."""
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))


def stored_key_counts(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """``key_counts``, counted now and written to the work folder: what reads it does not count again."""
    path = work_folder(df.sparkSession, "key-counts")
    key_counts(df, on).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def hot_keys(counts: DataFrame, on: Sequence[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The keys with more rows than a task should take, and how many tasks to use.

    A task should take ``rows_per_task`` rows, or ``HOT_SHARE`` of all rows if that is more. That bounds the number of
    hot keys by arithmetic, so their table can be broadcast and none is left out.
    """
    share = F.ceil(counts.agg(F.sum("_rows")).scalar() * HOT_SHARE)
    bound = F.greatest(F.lit(rows_per_task), share)
    known = counts.dropna(subset=list(on)).withColumn("_bound", bound)
    return known.where(F.col("_rows") > F.col("_bound")).select(
        *on, F.ceil(F.col("_rows") / F.col("_bound")).cast("int").alias("_salts")
    )


def used_keys(counts: DataFrame, on: Sequence[str]) -> DataFrame:
    """All keys; the test keeps the count in the plan, so that Spark counts only once."""
    return counts.where(F.col("_rows") > 0).select(*on)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    counts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join with the hot keys of ``left`` spread over several tasks.

    Rows of a hot key get a salt from the ``spread`` columns, and only the right
    rows of such keys are repeated, once per salt. Every left row meets each of
    its right rows exactly once, so the result is that of the plain join. Rows
    with a null key meet nothing and are spread over all tasks.
    Keys are counted at once, unless ``counts`` brings the key counts of a cheaper table than ``left``; which
    keys are hot does not change the result. ``how`` is ``left`` or ``inner``.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    counts = stored_key_counts(left, on) if counts is None else counts
    hot = F.broadcast(hot_keys(counts, on, rows_per_task))
    spreading = F.xxhash64(*spread)
    no_key = reduce(or_, [F.col(c).isNull() for c in on])
    salts = F.when(no_key, F.lit(NULL_SALTS)).otherwise(F.col("_salts"))
    salt = F.coalesce(F.pmod(spreading, salts), F.lit(0)).cast("int")
    salted = left.join(hot, list(on), "left").withColumn("_salt", salt).drop("_salts")
    repeats = F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0)))
    repeated = right.dropna(subset=list(on)).join(hot, list(on), "left").withColumn("_salt", F.explode(repeats)).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
