"""Writers. Each writes a table in parallel; none gathers rows in one place."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT_BY_TASKS = "mapreduce.fileoutputcommitter.algorithm.version"
# Spark's name for rows without a key.
NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def write_run_index(records: DataFrame, header: DataFrame, path: str) -> None:
    """Write the records and the header of runs to the index tables, in place of what these runs had.

    Takes whole runs: what a run had before goes, also instances that ``records`` does not hold. To add instances to a
    run while it goes on, append to a log: ``sources.index_log``. Other runs keep their rows, and writing a run again
    changes nothing. A run that is not finished has no ``completed_at``; see ``outcomes.complete_headers``.
    """
    for rows, name in ((records, "records"), (header, "headers")):
        rows.write.partitionBy("run_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(
            f"{path}/{name}"
        )


def latest_headers(headers: DataFrame) -> DataFrame:
    """One header per run: the completed one if there is one."""
    rest = [c for c in headers.columns if c not in ("run_id", "completed_at")]
    return headers.groupBy("run_id").agg(
        F.max("completed_at").alias("completed_at"),
        *[F.max_by(c, F.coalesce("completed_at", F.lit(""))).alias(c) for c in rest],
    )


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines by run; fields that are null are left out."""
    reports.write.partitionBy("run_id").mode("overwrite").json(path)


def write_errors(errors: DataFrame, path: str) -> None:
    """The errors of a job, in place of those of an earlier run of it."""
    errors.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def write_artifacts(artifacts: DataFrame, path: str) -> None:
    """Prompt, response and patch texts as one table, not a file per row."""
    artifacts.write.mode("overwrite").parquet(path)


def write_frames(frames: DataFrame, path: str) -> None:
    """Typed frames as Parquet by kind, the form that later jobs read.

    Rows of a trace stay together and in order as they come from the scan, so
    no shuffle is needed to write them.
    """
    frames.write.partitionBy("kind").mode("overwrite").parquet(path)


def write_texts_by(rows: DataFrame, key: str, path: str) -> None:
    """The texts of (key, text) as the lines of a file in a folder for each key: ``<path>/<key>=<value>/part-...``.

    Keys are whole numbers. Rows of a key go to one task, which puts its file in place when it is whole.
    """
    spark = rows.sparkSession
    whole = rows.select(F.col(key), F.col("text")).repartition(4 * spark.sparkContext.defaultParallelism, key)
    folder = _mounted(spark, path)
    if folder is None:
        # Tasks move their files, as many take the driver too long one after the other.
        whole.write.option(COMMIT_BY_TASKS, 2).partitionBy(key).text(path)
        return
    os.makedirs(folder, exist_ok=True)
    ordered = whole.select(F.col(key).cast("string"), F.col("text").cast("binary")).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((k, text) for b in batches for k, text in zip(b.column(0).to_pylist(), b.column(1)))
        for value, texts in groupby(lines, itemgetter(0)):
            parent = f"{folder}/{key}={NO_KEY if value is None else value}"
            made = f"{parent}/.{uuid.uuid4().hex}"
            os.makedirs(parent, exist_ok=True)
            with open(made, "wb", buffering=0) as file:
                for _, text in texts:
                    file.write(text.as_buffer())
                    file.write(b"\n")
            os.replace(made, f"{parent}/part-00000.txt")
        return iter(())

    ordered.mapInArrow(run, "done boolean").write.format("noop").mode("overwrite").save()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The folder as Python names it, if it is on a disk that all executors see as theirs.

    To make a file there, Hadoop starts a process to set its mode and one for that of its checksum, unless its native
    library is installed. This takes some fifty times as long as to make the file.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None
