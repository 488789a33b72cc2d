"""Long texts as ordered parts with byte offsets: prompts, transcripts and logs that are read by the stretch.

Operators give a long text as rows with an ordinal, one per block or message. Here each part gets the byte it starts at, a
running sum of sizes in order of the ordinals that no task has to hold a whole text for, and the table is written sorted by
text and offset. Any stretch of any text is then read from the parts that overlap it, found in a small table of 64 KiB
pages; the text is never put together, whatever its length. The parts in order, one after the other, are the text.

Ordinals are unique in a text; a null part is empty. Offsets count UTF-8 bytes, so a stretch may cut a character and comes
as bytes. A stretch that reaches beyond its text ends with it; one of an unknown text, or of no bytes, has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.operators.ordinals import sequence_number

PAGE_BYTES = 1 << 16


def write_parts(parts: DataFrame, path: str, keys: Sequence[str], order: str = "ordinal", text: str = "text") -> None:
    """Write the parts (keys, order, text) of texts below ``path``, in place of what is there."""
    spark = parts.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = parts.select(*keys, F.col(order).alias("ordinal"), body.alias("text"))
    size = F.octet_length("text").cast("long")
    placed = sequence_number(rows, keys, "ordinal", "place", total="n_parts", sums={"start": size})
    columns = [*keys, "ordinal", "place", "n_parts", F.col("start").cast("long").alias("start"), size.alias("n_bytes"), "text"]
    # Files and row groups hold neighbouring offsets, so a filter on text and offset skips the others.
    placed.select(*columns).repartitionByRange(*keys, "start").sortWithinPartitions(*keys, "start").write.mode(
        "overwrite"
    ).parquet(f"{path}/parts")
    stored = spark.read.parquet(f"{path}/parts").where("n_bytes > 0")
    first, last = _page(F.col("start")), _page(F.col("start") + F.col("n_bytes") - 1)
    pages = stored.select(*keys, F.explode(F.sequence(first, last)).alias("page"), "place", "start", "n_bytes")
    pages.write.mode("overwrite").parquet(f"{path}/pages")


def _page(byte: Column) -> Column:
    return F.floor(byte / PAGE_BYTES).cast("long")


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(keys, ordinal, place, n_parts, start, n_bytes, text): all parts."""
    return spark.read.parquet(f"{path}/parts")


def text_sizes(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """(keys, parts, total_bytes): one row per text, from offsets alone."""
    ends = F.max(F.col("start") + F.col("n_bytes"))
    return read_parts(spark, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("parts"), ends.alias("total_bytes"))


def stretch_parts(
    spark: SparkSession, path: str, requests: DataFrame, keys: Sequence[str], request_key: str = "request_id"
) -> DataFrame:
    """(request, place, bytes): for each stretch (request, keys, first_byte, n_bytes) what each part has of it.

    In order of ``place`` these are the stretch. Requests meet the pages they touch by an equi-join of small rows; only the
    parts that are found bring their texts.
    """
    asked = requests.select(
        F.col(request_key).alias("_request"),
        *[F.col(k).alias(f"_{k}") for k in keys],
        F.greatest(F.col("first_byte").cast("long"), F.lit(0)).alias("_from"),
        (F.col("first_byte") + F.col("n_bytes")).cast("long").alias("_to"),
    ).where(F.col("_to") > F.col("_from"))
    touched = asked.withColumn("_page", F.explode(F.sequence(_page(F.col("_from")), _page(F.col("_to") - 1))))
    pages = spark.read.parquet(f"{path}/pages")
    met = touched.join(pages, _same(keys) & (F.col("page") == F.col("_page")))
    end = F.col("start") + F.col("n_bytes")
    # A part and a stretch may share several pages; they meet in the first of these.
    first = F.greatest(_page(F.col("start")), _page(F.col("_from")))
    found = met.where((F.col("start") < F.col("_to")) & (end > F.col("_from")) & (F.col("page") == first))
    found = found.select("_request", *[F.col(f"_{k}") for k in keys], F.col("place").alias("_place"), "_from", "_to")
    texts = read_parts(spark, path).select(*keys, "place", "start", F.col("text").cast("binary").alias("_bytes"))
    cut_from = F.greatest(F.col("_from") - F.col("start"), F.lit(0))
    cut = F.substring("_bytes", (cut_from + 1).cast("int"), (F.col("_to") - F.col("start") - cut_from).cast("int"))
    joined = found.join(texts, _same(keys) & (F.col("place") == F.col("_place")))
    return joined.select(F.col("_request").alias(request_key), "place", cut.alias("bytes"))


def read_stretches(
    spark: SparkSession, path: str, requests: DataFrame, keys: Sequence[str], request_key: str = "request_id"
) -> DataFrame:
    """(request, bytes): each stretch as one value, for stretches that fit into one."""
    parts = stretch_parts(spark, path, requests, keys, request_key)
    in_order = F.array_sort(F.collect_list(F.struct("place", F.hex("bytes").alias("hex"))))
    whole = F.unhex(F.array_join(F.transform(in_order, lambda p: p["hex"]), ""))
    return parts.groupBy(request_key).agg(whole.alias("bytes"))


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
