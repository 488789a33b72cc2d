"""The run index as a log: records are appended batch by batch while runs go on, and read as the latest of each instance.

Below its path a log has a folder per batch of ``records`` and of ``headers``, and a table of ``commits``, one row per
batch that is complete: its kind, name and sequence number. A batch is written first and committed then, so what a lost
job left half-written has no commit and is never read; the job writes the batch again under the same name. A batch that
is committed is not written twice, so appending is repeatable. Of an instance that was recorded more than once the batch
with the highest sequence number counts, and of batches that two writers committed under the same number the later name.

``compact`` puts all that counts into one batch, which stands for everything up to its sequence number; readers then skip
the older batches, and what is appended meanwhile stays. So a log is read from as many batches as were appended since.

Records are chosen on numbers and fetched where they lie, see ``operators.late``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import utc_iso
from tracelake.operators.late import FileRows, fetch_rows, file_rows, last_of

RECORDS, HEADERS = "records", "headers"
KEYS = {RECORDS: ("run_id", "instance_id"), HEADERS: ("run_id",)}
COMMIT = "kind string, batch string, sequence long, is_base boolean"
NAME = re.compile(r"[A-Za-z0-9][\w.-]*")


def append_records(records: DataFrame, path: str, batch: str) -> bool:
    """Append index records, at most one per instance; False if the batch was committed before."""
    return _append(records, path, RECORDS, batch)


def append_headers(headers: DataFrame, path: str, batch: str) -> bool:
    """Append headers of runs, at most one per run: as they begin, or with what has become known."""
    return _append(headers, path, HEADERS, batch)


def finalise_runs(spark: SparkSession, path: str, run_ids: Sequence[str], batch: str, completed_at: Column | None = None) -> bool:
    """Mark runs as done. Their headers are those that counted, with the time of completion."""
    headers = read_headers(spark, path).where(F.col("run_id").isin(*run_ids))
    return append_headers(headers.withColumn("completed_at", utc_iso(completed_at)), path, batch)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The record that counts of each instance, of runs that are done or still go on."""
    return _latest(spark, path, RECORDS)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The header that counts of each run."""
    return _latest(spark, path, HEADERS)


def compact(spark: SparkSession, path: str, batch: str, kind: str = RECORDS) -> bool:
    """Put everything that counts now into one batch; False if there is nothing to put together, or it was done before."""
    live = _live(spark, path, kind)
    if len(live) < 2 or any(c["batch"] == batch for c in _commits(spark, path, kind)):
        return False
    rows = _of_batches(spark, path, kind, live)
    rows.write.mode("overwrite").parquet(_folder(path, kind, batch))
    _commit(spark, path, kind, batch, max(c["sequence"] for c in live), is_base=True)
    return True


def expired_batches(spark: SparkSession, path: str, kind: str = RECORDS) -> list[str]:
    """Folders of committed batches that no reader needs any more. A reader that began before ``compact`` may still do."""
    live = {c["batch"] for c in _live(spark, path, kind)}
    return sorted(_folder(path, kind, c["batch"]) for c in _commits(spark, path, kind) if c["batch"] not in live)


def _append(rows: DataFrame, path: str, kind: str, batch: str) -> bool:
    if not NAME.fullmatch(batch):
        raise ValueError("a batch is named by letters, digits, '_', '.' and '-'")
    spark = rows.sparkSession
    known = _commits(spark, path, kind)
    if any(c["batch"] == batch for c in known):
        return False
    # In place of what a lost attempt may have left.
    rows.write.mode("overwrite").parquet(_folder(path, kind, batch))
    _commit(spark, path, kind, batch, 1 + max((c["sequence"] for c in known), default=0), is_base=False)
    return True


def _folder(path: str, kind: str, batch: str) -> str:
    return f"{path}/{kind}/batch={batch}"


def _commit(spark: SparkSession, path: str, kind: str, batch: str, sequence: int, is_base: bool) -> None:
    marker = spark.createDataFrame([(kind, batch, sequence, is_base)], COMMIT)
    marker.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def _commits(spark: SparkSession, path: str, kind: str) -> list[Row]:
    """The commits of a kind, one row per batch; none for a log that has not begun."""
    try:
        commits = spark.read.schema(COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return commits.where(F.col("kind") == kind).collect()


def _live(spark: SparkSession, path: str, kind: str) -> list[Row]:
    """The batches a reader needs: the last one that stands for others, and all with a higher number."""
    commits = _commits(spark, path, kind)
    bases = [c for c in commits if c["is_base"]]
    if not bases:
        return commits
    base = max(bases, key=lambda c: (c["sequence"], c["batch"]))
    return [base, *(c for c in commits if not c["is_base"] and c["sequence"] > base["sequence"])]


def _latest(spark: SparkSession, path: str, kind: str) -> DataFrame:
    live = _live(spark, path, kind)
    if not live:
        raise ValueError(f"the log at {path} has no {kind}")
    return _of_batches(spark, path, kind, live)


def _of_batches(spark: SparkSession, path: str, kind: str, batches: Sequence[Row]) -> DataFrame:
    # One number per batch, in the order in which they count.
    ranked = sorted(batches, key=lambda c: (c["sequence"], c["batch"]))
    order = spark.createDataFrame([(c["batch"], n) for n, c in enumerate(ranked)], "_batch string, _order long")
    raw = (
        spark.read.option("mergeSchema", "true")
        .option("basePath", f"{path}/{kind}")
        .option("recursiveFileLookup", "false")
        .parquet(*[_folder(path, kind, c["batch"]) for c in ranked])
    )

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(order), F.col("batch").cast("string") == F.col("_batch")).drop("batch", "_batch")

    table: FileRows = file_rows(raw, numbered)
    return fetch_rows(table, last_of(table.rows(), KEYS[kind], "_order")).drop("_order")
