"""Streaming forms of the index and of the metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.operators.outcomes import normalize_records, outcomes, report_results, run_order

RECORD_KEY = ("run_id", "instance_id", "variant")
# Records are dealt into so many states.
BUCKETS = 1 << 14


def record_stream(runs: DataFrame) -> DataFrame:
    """Arriving runs as index records, row by row and without state."""
    return normalize_records(outcomes(runs)).drop("output", "patch")


def report_stream(reports: DataFrame) -> DataFrame:
    """Arriving comparison reports as index records, three rows per report."""
    return normalize_records(report_results(reports))


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a Parquet table, taking what has arrived and then ending."""
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def running_counts(
    records: DataFrame, keys: Sequence[str] = RECORD_KEY, event_time: str = "recorded_at", horizon: str = "7 days"
) -> DataFrame:
    """Running count of records by run, variant, status and reason, for a display that follows the runs.

    A record that is delivered again within ``horizon`` of its first arrival is
    counted once; the horizon is what bounds the state, so a later repeat
    counts again. Exact counts come from the record table: ``record_counts``.
    """
    unique = records.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(keys))
    return unique.groupBy("run_id", "variant", "status", "failure_reason").agg(F.count(F.lit(1)).alias("n"))


def record_counts(records: DataFrame, keys: Sequence[str] = RECORD_KEY) -> DataFrame:
    """Count of records by run, variant, status and reason, from the table that a stream has appended to.

    Each record counts once, however often and however late it was delivered: the latest counts, by ``recorded_at`` if
    there is one and by status among equals.
    """
    state = F.struct("status", "failure_reason")
    latest = records.groupBy(*keys).agg(F.max_by(state, F.struct(run_order(records), *_texts())).alias("_s"))
    return latest.groupBy("run_id", "variant", "_s.status", "_s.failure_reason").agg(F.count(F.lit(1)).alias("n"))


def _texts() -> list[Column]:
    """What decides between records of one time and status."""
    return [F.coalesce("failure_reason", F.lit("")).alias("reason")]


def count_changes(records: DataFrame, keys: Sequence[str] = RECORD_KEY, buckets: int = BUCKETS) -> DataFrame:
    """What arriving records change in the counts: (run_id, variant, status, failure_reason, n), n being 1 or -1.

    The state holds, for each record, the time, status and reason that were counted last. A newer delivery takes the old
    one back and adds itself; an older one, or the same again, changes nothing, however late it comes. So the sum of all
    changes is that of ``record_counts``, and the state is three small values per record, on the executors.

    A hash of the key deals records into ``buckets``, whose records share one state: Python is called once per bucket of a
    trigger, not once per record. Queries that go on from a checkpoint need the ``buckets`` they began with.
    """
    of = {f.name: f.dataType for f in records.schema.fields}
    place = {k: list(keys).index(k) for k in ("run_id", "variant")}
    # The key as one text, which tells nulls from texts.
    key = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    dealt = records.select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket"),
        key.alias("_key"),
        run_order(records).alias("_order"),
        "status",
        "failure_reason",
    )

    def change(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict[str, tuple] = {k: tuple(v) for k, *v in zip(*state.get)} if state.exists else {}
        before: dict[str, tuple | None] = {}
        for part in parts:
            for key, order, status, reason in zip(*(part[c].tolist() for c in ("_key", "_order", "status", "failure_reason"))):
                found = (int(order), None if pd.isna(status) else status, None if pd.isna(reason) else reason)
                old = best.get(key)
                if old is None or (found[0], found[2] or "") > (old[0], old[2] or ""):
                    before.setdefault(key, old)
                    best[key] = found
        if before:
            state.update(tuple(map(list, zip(*((k, *v) for k, v in best.items())))))
            rows = [(k, *best[k][1:], 1) for k in before]
            rows += [(k, *old[1:], -1) for k, old in before.items() if old is not None]
            yield pd.DataFrame(rows, columns=["_key", "status", "failure_reason", "n"])

    changes = dealt.groupBy("_bucket").applyInPandasWithState(
        change,
        "_key string, status string, failure_reason string, n long",
        "key array<string>, at array<long>, status array<string>, failure_reason array<string>",
        "append",
        GroupStateTimeout.NoTimeout,
    )
    texts = F.from_json("_key", "array<string>")
    named = [F.get(texts, F.lit(n)).cast(of[k]).alias(k) for k, n in place.items()]
    return changes.select(*named, "status", "failure_reason", "n")


def write_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add up the changes of each trigger and keep them as one table per trigger; a repeated trigger writes the same table."""

    def save(batch: DataFrame, epoch: int) -> None:
        sum_of_changes(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        changes.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sum_of_changes(changes: DataFrame) -> DataFrame:
    """Counts from changes; groups that nothing is left of have no row."""
    return (
        changes.groupBy("run_id", "variant", "status", "failure_reason").agg(F.sum("n").alias("n")).where(F.col("n") != 0)
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest counts as one table per trigger; a repeated trigger writes the same table."""

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (
        counts.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )


def latest_counts(tables: DataFrame) -> DataFrame:
    """The counts of the last trigger, from the folder that ``write_counts`` keeps."""
    last = tables.agg(F.max("epoch").alias("epoch")).scalar()
    return tables.where(F.col("epoch") == last).drop("epoch")


def metrics_of_counts(counts: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Totals and rates from running counts."""
    total = F.col("total_instances")
    return (
        counts.groupBy(*keys, "variant")
        .agg(
            F.sum("n").alias("total_instances"),
            F.sum(F.when(F.col("status") == "passed", F.col("n")).otherwise(0)).alias("success_count"),
        )
        .withColumn("failure_count", total - F.col("success_count"))
        .withColumn("success_rate", F.when(total > 0, F.col("success_count") / total).otherwise(0.0))
        .withColumn("failure_rate", F.when(total > 0, F.col("failure_count") / total).otherwise(0.0))
    )
