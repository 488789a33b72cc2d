"""Patch operators: diffs to hunk and line rows, and back. None of them shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.diffs import assemble_diff, diff_error, extract_diff, parse_diff


def extract_patches(responses: DataFrame, column: str = "content") -> DataFrame:
    """Add ``patch``: the first diff of a model response."""
    return responses.withColumn("patch", extract_diff(F.coalesce(column, F.lit(""))))


def parse_patches(patches: DataFrame, column: str = "patch", strict: bool = False) -> DataFrame:
    """Add ``files`` (nested hunks) and ``error``; a patch with an error has no files."""
    parsed = patches.withColumn("_files", parse_diff(F.col(column), strict))
    error = diff_error(F.col("_files"))
    plain = F.transform("_files", lambda f: f.dropFields("error"))
    return (
        parsed.withColumn("error", error)
        .withColumn("files", F.when(F.col("error").isNull(), plain).otherwise(F.slice(plain, 1, 0)))
        .drop("_files")
    )


def explode_hunks(patches: DataFrame, keys: Sequence[str], column: str = "patch", strict: bool = False) -> DataFrame:
    """One row per hunk, numbered inside file and patch."""
    parsed = patches.select(*keys, parse_diff(F.col(column), strict).alias("_files"))
    # Exploding an expression keeps Spark from testing its size in a filter of its
    # own, which would parse every patch again.
    sound = F.when(diff_error(F.col("_files")).isNull(), F.col("_files"))
    files = parsed.select(*keys, F.posexplode(sound).alias("file_no", "f"))
    hunks = files.select(*keys, "file_no", F.col("f.path").alias("path"), F.posexplode("f.hunks").alias("hunk_no", "h"))
    return hunks.select(*keys, "file_no", "path", "hunk_no", "h.*")


def patch_lines(hunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per line of a hunk, with its kind: added, deleted or context."""
    lines = hunks.select(*keys, "file_no", "path", "hunk_no", F.posexplode("lines").alias("line_no", "line"))
    kind = F.when(F.col("line").startswith("+"), "added").when(F.col("line").startswith("-"), "deleted")
    return lines.withColumn("kind", kind.otherwise("context"))


def patch_errors(patches: DataFrame, keys: Sequence[str], column: str = "patch", strict: bool = False) -> DataFrame:
    """Patches that cannot be parsed, with the reason."""
    return parse_patches(patches, column, strict).where("error is not null").select(*keys, "error")


def assemble_patches(patches: DataFrame, column: str = "patch", strict: bool = False) -> DataFrame:
    """Add ``diff``: the patch as one git-style diff."""
    parsed = parse_patches(patches, column, strict)
    return parsed.withColumn("diff", assemble_diff(F.col("files"))).drop("files", "error")
