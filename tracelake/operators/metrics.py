"""Success and failure metrics over index records, and collection summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.schemas import VARIANTS


def variant_metrics(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals, successes, failures and their rates per run and variant.

    ``records`` is the long form, one row per instance and variant.
    """
    total = F.count(F.lit(1))
    success = F.count_if(F.col("status") == "passed")
    counted = records.groupBy(*keys, "variant").agg(
        total.alias("total_instances"), success.alias("success_count")
    )
    failures = F.greatest(F.col("total_instances") - F.col("success_count"), F.lit(0))
    return counted.select(
        *keys,
        "variant",
        "total_instances",
        "success_count",
        failures.alias("failure_count"),
        _rate(F.col("success_count"), F.col("total_instances")).alias("success_rate"),
        _rate(failures, F.col("total_instances")).alias("failure_rate"),
    )


def status_counts(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return records.groupBy(*keys, "variant", F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("n")
    )


def failure_reason_counts(records: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Reasons of the runs that did not pass."""
    reason = F.coalesce(F.nullif(F.col("failure_reason"), F.lit("")), F.lit("unknown"))
    return (
        records.where(~F.col("status").eqNullSafe("passed"))
        .groupBy(*keys, "variant", reason.alias("failure_reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ranked_reasons(counts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Failure reasons by falling count, then by name."""
    return counts.orderBy(*keys, "variant", F.desc("n"), F.asc("failure_reason"))


def run_metrics(
    records: DataFrame, headers: DataFrame, keys: Sequence[str] = ("run_id",)
) -> DataFrame:
    """Run header with the metrics of both variants and the two count maps.

    One pass over the records: they are counted by variant, status and reason,
    and the few counts of a run are folded into its row together with its header.
    """
    reason = F.coalesce(F.nullif(F.col("failure_reason"), F.lit("")), F.lit("unknown"))
    counts = records.groupBy(
        *keys,
        "variant",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.when(~F.col("status").eqNullSafe("passed"), reason).alias("reason"),
    ).agg(F.count(F.lit(1)).alias("n"))
    folded = counts.groupBy(*keys).agg(F.collect_list(F.struct("variant", "status", "reason", "n")).alias("_counts"))
    kept = [c for c in ("run_id", "dataset", "split", "model", "created_at", "completed_at") if c in headers.columns]
    # A run has one header and one row of counts, which meet in a group: no join.
    head = headers.select(*keys, F.struct(*kept).alias("_header"))
    met = head.unionByName(folded, allowMissingColumns=True).groupBy(*keys).agg(
        F.first("_header", ignorenulls=True).alias("_header"), F.first("_counts", ignorenulls=True).alias("_counts")
    )
    every = F.coalesce("_counts", F.array().cast(folded.schema["_counts"].dataType))
    return met.where("_header is not null").select(
        "_header.*", *[_metrics(F.filter(every, lambda c: c["variant"] == v)).alias(v) for v in VARIANTS]
    )


def _metrics(counts: Column) -> Column:
    """The metrics of one variant from its counts; zero counts without any."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda n, c: n + c["n"])

    def count_map(field: str) -> Column:
        names = F.array_sort(F.array_distinct(F.array_compact(F.transform(counts, lambda c: c[field]))))
        entry = lambda name: F.struct(name, total(F.filter(counts, lambda c: c[field] == name)))
        return F.map_from_entries(F.transform(names, entry))

    every, success = total(counts), total(F.filter(counts, lambda c: c["status"] == "passed"))
    return F.struct(
        every.alias("total_instances"),
        success.alias("success_count"),
        (every - success).alias("failure_count"),
        _rate(success, every).alias("success_rate"),
        _rate(every - success, every).alias("failure_rate"),
        count_map("status").alias("status_counts"),
        count_map("reason").alias("failure_reason_counts"),
    )


def collection_summary(runs: DataFrame, keys: Sequence[str] = ("framework",)) -> DataFrame:
    """Total, successful and failed runs and the failures they captured, per group."""
    ok = F.coalesce("success", F.lit(False))
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("num_failures"))), F.lit(0)).alias("failures_captured"),
    )


def num_failures(traces: DataFrame, keys: Sequence[str] = ("run_id", "instance_id")) -> DataFrame:
    """Captured failing tests per run and instance."""
    return traces.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_failures"))


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)
