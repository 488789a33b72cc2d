"""Session defaults and the shared work folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


def build_session(app: str = "tracelake", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark.

    A cluster job brings its own session; the library only relies on UTC and on
    adaptive execution, which are Spark's defaults or set here.
    """
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, for jobs of many rounds.

    Spark deletes the shuffle files and broadcasts of finished rounds, on all executors, when the driver no longer knows the
    plans they belong to; without this that may be after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@lru_cache(1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tracelake-")


def work_folder(spark: SparkSession, label: str, base: str | None = None) -> str:
    """A new folder under ``base``, or under ``spark.checkpoint.dir``, which all executors share.

    Only a local-mode session without that setting gets a temporary folder, one
    for the whole process.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = _local_folder()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
