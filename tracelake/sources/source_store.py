"""Sources of many instances, each distinct text stored once under the hash of its bytes.

Projects at neighbouring commits share nearly all of their files. A store has a ``manifest``, one small row per file of an
instance with the hash and the number of lines of its text, and the ``contents``, one row per distinct text. Joins go by
hashes: frames find their file in the manifest, the distinct lines that are asked of a text are put together, and each
text is read and split once, however many instances, traces and frames point into it. Texts never move with frames.

A store is filled in steps: texts that it has are not written again, and an instance that is added again replaces nothing,
so the manifest is read as distinct rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import SOURCE_UNAVAILABLE, source_context, split_lines
from tracelake.operators.source import INSTANCE


def add_sources(files: DataFrame, path: str, keys: Sequence[str] = INSTANCE) -> None:
    """Add files (keys, path, content) to the store below ``path``. A null content is a file that is not there.

    Contents are written before the manifest, so no hash is ever listed without its text; a lost job leaves texts at most,
    and running it again writes the rest.
    """
    spark = files.sparkSession
    content = F.col("content")
    hashed = files.where(content.isNotNull()).select(*keys, "path", F.sha2(content.cast("binary"), 256).alias("hash"), "content")
    texts = hashed.select("hash", "content")
    known = _contents(spark, path)
    if known is not None:
        texts = texts.join(known.select("hash"), "hash", "left_anti")
    # Of equal hashes any text will do; map tasks already keep one of each.
    texts.groupBy("hash").agg(F.any_value("content").alias("content")).write.mode("append").parquet(f"{path}/contents")
    listed = hashed.select(*keys, "path", "hash", F.size(split_lines(F.col("content"))).alias("n_lines"))
    listed.write.mode("append").parquet(f"{path}/manifest")


def _contents(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/contents")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(keys, path, hash, n_lines): each file of an instance once."""
    return spark.read.parquet(f"{path}/manifest").distinct()


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """(hash, content): each text once, also where a lost job wrote some of them twice."""
    return spark.read.parquet(f"{path}/contents").dropDuplicates(["hash"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(keys, path, content) as they were added."""
    return read_manifest(spark, path).join(read_contents(spark, path), "hash").drop("hash", "n_lines")


def with_stored_context(
    frames: DataFrame, path: str, around: int = 8, keys: Sequence[str] = INSTANCE, line: str = "line"
) -> DataFrame:
    """Frames with the source lines around them, from a store: the rows of ``source.with_source_context``."""
    spark = frames.sparkSession
    on = [*keys, "file"]
    listed = read_manifest(spark, path).withColumnRenamed("path", "file")
    placed = frames.join(listed, on, "left").withColumn(
        # The line that is shown: inside of the file.
        "_focus", F.least(F.greatest(F.col(line).cast("int"), F.lit(1)), F.col("n_lines"))
    )
    # At most as many lines as a text has, put together before the text is read.
    asked = placed.where("hash is not null and _focus is not null").groupBy("hash").agg(F.collect_set("_focus").alias("_asked"))
    split = read_contents(spark, path).join(asked, "hash").select("hash", "_asked", split_lines(F.col("content")).alias("_lines"))
    shown = split.select("hash", "_lines", F.explode("_asked").alias("_focus")).select(
        "hash", "_focus", source_context(F.col("_lines"), F.col("_focus"), around).alias("context")
    )
    joined = placed.join(shown, ["hash", "_focus"], "left")
    return joined.select(*frames.columns, F.coalesce("context", F.lit(SOURCE_UNAVAILABLE)).alias("context"))
