"""Large JSON documents in one piece: the objects of a list, read by as many tasks as the file has blocks.

A document without line breaks, or one object around a long list, is no table of lines. Here it is read in segments that
end at closing braces, wherever Spark splits the file. What a segment holds depends on what comes before it in two ways:
whether it starts inside of a string (the parity of the quotes before it), and how deep it is nested (the brackets outside
of strings before it). A closing brace outside of strings that leads back to the depth of the list ends an element; segments
between two such ends are put together, an element at a time. Each of these is a running sum inside of a block, which no
task finds too large, and one small row per block carries what the blocks before it hold.

The elements of the list must be objects. What stands before the first element and behind the last one is the head and the
tail of its document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.session import release, work_folder

OPENING, CLOSING = "{", "}"
# Names of files that Spark reads through a codec; of these the size of the text is not the size of the file.
COMPRESSED = r"\.(gz|gzip|bz2|deflate|lz4|snappy|zst|zstd)$"

BLOCK = ["path", "block"]


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, segment, size, value): the texts between closing braces, in order of their block and number.

    ``size`` is the number of bytes of the file, as stored. Numbers grow in the order of a block, as one task reads it.
    """
    return spark.read.option("lineSep", CLOSING).text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("segment"),
        F.col("_metadata.file_size").alias("size"),
        "value",
    )


def _nesting(outside: Column) -> Column:
    """Opening less closing brackets of a text without strings."""
    opened = F.length(F.regexp_replace(outside, r"[^\[{]+", ""))
    return (opened - F.length(F.regexp_replace(outside, r"[^\]}]+", ""))).cast("long")


def _with_facts(segments: DataFrame) -> DataFrame:
    """Per segment its quotes, and its nesting if it starts outside (``_out``) or inside (``_in``) of a string."""
    # An escaped character says nothing; a segment never ends between a backslash and what it escapes, as a brace is not.
    plain = segments.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))
    rest = F.regexp_replace("_plain", r'\A[^"]*(?:"|\z)', "")
    strings = r'"[^"]*(?:"|\z)'
    return plain.withColumns(
        {
            "_quotes": F.length(F.regexp_replace("_plain", r'[^"]+', "")).cast("long"),
            "_out": _nesting(F.regexp_replace("_plain", strings, "")),
            "_in": _nesting(F.regexp_replace(rest, strings, "")),
        }
    ).drop("_plain")


def _sum_before(amount: Column, keys: list[str], order: str) -> Column:
    rows = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(rows), F.lit(0))


def split_list(spark: SparkSession, path: str, depth: int = 1, segments: DataFrame | None = None) -> DataFrame:
    """(path, element, value): the documents below ``path``, cut behind each object that ends at ``depth``.

    At depth 1 these are the elements of a list, at depth 2 those of a list in an object. The value of the first element
    starts with the head of the document, the others with the comma before them; the last row is the tail. The segments,
    their numbers and the elements are written, each once. ``segments`` are those of the path, if they are listed already.
    """
    folder = work_folder(spark, "segments")
    facts = _with_facts(read_segments(spark, path) if segments is None else segments)
    facts.write.option("compression", "zstd").parquet(folder)
    segments = spark.read.parquet(folder)

    blocks = segments.groupBy(*BLOCK, "size").agg(
        F.sum("_quotes").alias("_n"), F.max("segment").alias("_last"), F.sum(F.octet_length("value") + 1).alias("_bytes")
    )
    blocks = _with_text_sizes(spark, path, segments, blocks)
    whole_file = Window.partitionBy("path")
    # A brace follows on every segment but, as the number of bytes shows, the last one of the file.
    unclosed = (F.col("block") == F.max("block").over(whole_file)) & (F.sum("_bytes").over(whole_file) > F.col("size"))
    starts = blocks.select(
        *BLOCK, _sum_before(F.col("_n"), ["path"], "block").alias("_quotes_before"), F.when(unclosed, F.col("_last")).alias("_unclosed")
    )
    quotes = F.col("_quotes_before") + _sum_before(F.col("_quotes"), BLOCK, "segment")
    quoted = segments.select(*BLOCK, "segment", "_quotes", "_out", "_in").join(starts, BLOCK).select(
        *BLOCK, "segment", "_quotes", "_out", "_in", quotes.alias("_before"), (~F.col("segment").eqNullSafe(F.col("_unclosed"))).alias("closed")
    )
    closing = ((F.col("_before") + F.col("_quotes")) % 2 == 0) & F.col("closed")
    step = F.when(F.col("_before") % 2 == 1, F.col("_in")).otherwise(F.col("_out")) - closing.cast("long")
    placed = quoted.select(*BLOCK, "segment", "closed", closing.alias("_closing"), step.alias("_step"))
    placed = placed.withColumn("_depth", _sum_before(F.col("_step"), BLOCK, "segment") + F.col("_step"))
    placed = _written(spark, placed, "segment-depths")

    nested = placed.groupBy(*BLOCK).agg(F.sum("_step").alias("_n"))
    nested = nested.select(*BLOCK, _sum_before(F.col("_n"), ["path"], "block").alias("_depth_before"))
    end = (F.col("_closing") & (F.col("_depth_before") + F.col("_depth") == depth)).cast("long")
    ends = placed.join(nested, BLOCK).select(*BLOCK, "segment", "closed", end.alias("_end"))
    ends = ends.withColumn("_ends", _sum_before(F.col("_end"), BLOCK, "segment"))
    ends = _written(spark, ends, "segment-ends")

    counted = ends.groupBy(*BLOCK).agg(F.sum("_end").alias("_n"))
    counted = counted.select(*BLOCK, _sum_before(F.col("_n"), ["path"], "block").alias("_ends_before"))
    element = (F.col("_ends_before") + F.col("_ends")).alias("element")
    numbered = ends.join(counted, BLOCK).select(*BLOCK, "segment", "closed", element)
    text = F.concat("value", F.when(F.col("closed"), CLOSING).otherwise(""))
    # Both sides grow with the documents, however small they are as files: neither is sent to all.
    parts = segments.select(*BLOCK, "segment", "value").join(numbered.hint("merge"), [*BLOCK, "segment"])
    in_order = F.array_sort(F.collect_list(F.struct("block", "segment", text.alias("text"))))
    whole = F.array_join(F.transform(in_order, lambda p: p["text"]), "").alias("value")
    return _written(spark, parts.groupBy("path", "element").agg(whole), "elements")


def _with_text_sizes(spark: SparkSession, path: str, segments: DataFrame, blocks: DataFrame) -> DataFrame:
    """The blocks with the size of the text of compressed files in place of that of the file.

    It is the sum of the texts between opening braces, and of these braces, which are in the segments.
    """
    stored = segments.where(F.col("path").rlike(COMPRESSED))
    if stored.isEmpty():
        return blocks
    lines = spark.read.option("lineSep", OPENING).text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    between = lines.where(F.col("path").rlike(COMPRESSED)).groupBy("path").agg(F.sum(F.octet_length("value")).alias("_n"))
    braces = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(OPENING), F.lit("")))
    opened = stored.groupBy("path").agg(F.sum(braces).alias("_opened"))
    sizes = between.join(opened, "path").select("path", (F.col("_n") + F.col("_opened")).alias("_size"))
    sized = blocks.join(_written(spark, sizes, "text-sizes"), "path", "left")
    return sized.withColumn("size", F.coalesce("_size", "size")).drop("_size")


def _written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    folder = work_folder(spark, label)
    df.write.option("compression", "zstd").parquet(folder)
    release(spark)
    return spark.read.parquet(folder)


def read_objects(spark: SparkSession, path: str, segments: DataFrame | None = None) -> DataFrame:
    """(path, element, value): the objects of JSON lists, as texts of one line each. An empty list gives no rows."""
    rows = split_list(spark, path, segments=segments)
    # The head is the opening bracket, the tail the closing one; line breaks only stand outside of strings.
    value = F.regexp_replace(F.regexp_replace("value", r"\A\s*(?:\[|,)\s*", ""), r"[\r\n]+", " ")
    return rows.select("path", "element", value.alias("value")).where(F.col("value").startswith("{"))


def read_list_in_object(spark: SparkSession, path: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Documents that are an object around one long list of objects: the rest of each object, and the list's objects.

    (path, value) has the document with an empty list, (path, element, value) the objects. The other fields must not hold
    objects below the first level. Documents whose list is empty or not there have no objects.
    """
    rows = split_list(spark, path, 2)
    opening = rf'(?s)\A(\s*\{{.*?"{field}"\s*:\s*\[)\s*(\{{.*)\z'
    behind = F.regexp_replace("value", r"\A\s*,\s*", "")
    first = F.col("element") == 0
    holds = F.when(first, F.regexp_like("value", F.lit(opening))).otherwise(behind.startswith("{"))
    objects = rows.where(holds).select(
        "path", "element", F.when(first, F.regexp_extract("value", opening, 2)).otherwise(behind).alias("value")
    )
    # The head is what stands before the first object, the tail what stands behind the last one.
    rest = rows.select(
        "path", "element", F.when(first & holds, F.regexp_extract("value", opening, 1)).when(~holds, F.col("value")).alias("_rest")
    ).where(F.col("_rest").isNotNull())
    in_order = F.array_sort(F.collect_list(F.struct("element", "_rest")))
    whole = rest.groupBy("path").agg(F.array_join(F.transform(in_order, lambda p: p["_rest"]), "").alias("value"))
    return whole, objects
