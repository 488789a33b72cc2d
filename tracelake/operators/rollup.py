"""Metrics that are kept up to date: counts per ingested batch, added up over runs, variants and time.

Counts of records by run, variant, status and reason are sums, so those of a batch are all that later totals need of it. A
batch's counts are written once, under its name, from its records alone; totals add up small rows. A run recorded in more
batches than one is counted by what changed: ``count_batch`` takes the records that count now and those they replace.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ("run_id", "variant", "status", "failure_reason")
RUN = ("run_id",)


def _status_of(records: DataFrame) -> DataFrame:
    """The grouping of the metrics: an unknown status or reason has a name, a passed record no reason."""
    reason = F.coalesce(F.nullif(F.col("failure_reason"), F.lit("")), F.lit("unknown"))
    return records.select(
        "run_id",
        "variant",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(~F.col("status").eqNullSafe("passed"), reason).alias("failure_reason"),
    )


def count_batch(records: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """(run_id, variant, status, failure_reason, n): the counts of records, less those of the records they replace."""
    rows = _status_of(records).withColumn("n", F.lit(1).cast("long"))
    if replaced is not None:
        rows = rows.unionByName(_status_of(replaced).withColumn("n", F.lit(-1).cast("long")))
    return rows.groupBy(*GROUP).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def add_counts(counts: DataFrame, path: str, batch: str) -> None:
    """Write the counts of a batch; a batch that is written again is replaced, so a repeated job changes nothing."""
    counts.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches, one row per group."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "run_id string, variant string, status string, failure_reason string, n long")
    return rows.groupBy(*GROUP).agg(F.sum("n").alias("n")).where(F.col("n") != 0)


def compact_counts(spark: SparkSession, path: str, into: str) -> None:
    """Write the counts of all batches as those of one batch below another path, to go on from there."""
    add_counts(read_counts(spark, path), into, "base")


def rollup_metrics(counts: DataFrame) -> DataFrame:
    """Totals and rates by run and variant, of each run, and of all: a null run or variant stands for all of them.

    ``level`` is 0 for a run and variant, 1 for a run and 3 for everything.
    """
    passed = F.sum(F.when(F.col("status") == "passed", F.col("n")).otherwise(0))
    level = F.grouping_id()
    rolled = counts.rollup("run_id", "variant").agg(
        F.sum("n").alias("total_instances"), passed.alias("success_count"), level.cast("int").alias("level")
    )
    return rolled.withColumns(
        {
            "failure_count": F.col("total_instances") - F.col("success_count"),
            "success_rate": _rate(F.col("success_count"), F.col("total_instances")),
            "failure_rate": _rate(F.col("total_instances") - F.col("success_count"), F.col("total_instances")),
        }
    )


def reason_totals(counts: DataFrame, keys: Sequence[str] = ("run_id", "variant")) -> DataFrame:
    """Failure reasons with their numbers, most frequent first."""
    failed = counts.where(F.col("status") != "passed").groupBy(*keys, "failure_reason").agg(F.sum("n").alias("n"))
    return failed.orderBy(*keys, F.desc("n"), F.asc("failure_reason"))


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)
