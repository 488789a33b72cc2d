"""Line de-duplication on levelled sorted runs.

The documents are taken in batches, highest ids first. A batch sorts the hashes of its lines, merge-anti-joins them with
the runs so far, and adds a run of its own: lines seen for the first time with the document that keeps them, and counts
for lines seen before. When a level has ``FAN_IN`` runs they are merged into one run of the next level, so a line hash
is rewritten only a few times however many batches come. A line whose summed count reaches the bound is dropped from
every document but the highest one that holds it.

Runs are plain Parquet tables in the shared work folder, sorted by hash; a lost executor costs a re-read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.shared import BLANKS, lower_ascii, written

LINE = ["line_1", "line_2"]
FAN_IN = 4
BATCHES = 4
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """The line with ASCII white space stripped at both ends and A-Z lower-cased."""
    return F.btrim(lower_ascii(line), F.lit(BLANKS))


def text_key(text: Column) -> Column:
    """Tells rows with one document id and different texts apart; repeated rows share it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def long_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """A row per line whose key has at least ``min_chars`` code points: key hashes, document and place in it."""
    lines = docs.select(
        F.col(doc_id).alias("doc"),
        text_key(F.col(text)).alias("text_key"),
        F.posexplode(F.split(lower_ascii(F.col(text)), "\n")).alias("place", "line"),
    )
    keyed = lines.withColumn("key", F.btrim("line", F.lit(BLANKS))).where(F.length("key") >= min_chars)
    # Two hashes with different seeds: 128 bits, so that different lines do not meet by chance.
    hashes = F.xxhash64("key").alias("line_1"), F.xxhash64(F.lit(1), "key").alias("line_2")
    return keyed.select(*hashes, "doc", "text_key", "place")


class LineRuns:
    """Sorted runs of line hashes by level. A run has the hashes, ``docs`` and, where first seen, ``keeper``."""

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def seen(self) -> DataFrame:
        """The hashes in the runs, each once: a line is first seen in one run only."""
        return reduce(DataFrame.unionByName, self.runs()).where("first").select(*LINE)

    def add(self, batch: DataFrame) -> None:
        """Add the lines of a batch whose document ids are below all those added before."""
        by_doc = batch.groupBy(*LINE, "doc").agg(F.count(F.lit(1)).alias("_lines"))
        counted = by_doc.groupBy(*LINE).agg(F.count(F.lit(1)).alias("docs"), F.max("doc").alias("keeper"))
        if self.runs():
            counted = counted.transform(self._write)
            seen = self.seen()
            fresh = counted.join(seen.hint("merge"), LINE, "left_anti").withColumn("first", F.lit(True))
            known = counted.join(seen.hint("merge"), LINE, "left_semi").withColumn("first", F.lit(False))
            counted = fresh.unionByName(known.withColumn("keeper", F.lit(None).cast(fresh.schema["keeper"].dataType)))
        else:
            counted = counted.withColumn("first", F.lit(True))
        self.levels[0].append(self._write(counted))
        self._compact()

    def _write(self, run: DataFrame) -> DataFrame:
        return written(self.spark, run.sortWithinPartitions(*LINE), "line-run")

    def _compact(self) -> None:
        for n in range(64):
            if n == len(self.levels) or len(self.levels[n]) < self.fan_in:
                return
            merged = self.merged(self.levels[n])
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n] = []
            self.levels[n + 1].append(self._write(merged))

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """One run of several: counts add up, and the one keeper that a line has stays."""
        every = reduce(DataFrame.unionByName, runs)
        return every.groupBy(*LINE).agg(
            F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("first").alias("first")
        )

    def frequent(self, min_docs: int) -> DataFrame:
        """The lines that at least ``min_docs`` documents hold, and the document that keeps each."""
        if not self.runs():
            raise ValueError("no batch has been added")
        return self.merged(self.runs()).where(F.col("docs") >= min_docs).select(*LINE, "keeper")


def batch_bounds(lines: DataFrame, batches: int) -> list:
    """Ids that cut the documents into about equal batches, highest first."""
    if batches < 2:
        return []
    shares = [n / batches for n in range(1, batches)]
    return sorted(set(lines.agg(F.percentile_approx("doc", shares)).first()[0] or ()), reverse=True)


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    names: tuple[str, str, str] = ("n_lines", "n_dropped", "kept_text"),
) -> DataFrame:
    """``docs`` with ``names``: the lines, the dropped lines, the text of the others. Columns so named are replaced.

    Lines are what stands between line feeds. A line whose key (``line_key``) has at least ``min_chars`` code points and
    is in at least ``min_docs`` documents stays only in the one with the largest id; all other lines stay, and are
    joined by line feeds. A null or empty text is one empty line. Documents are told apart by id, which must be a number:
    rows that repeat an id count once, but each is treated by its own text. Rows without an id count as one document
    below all others; they lose frequent lines, as another document keeps them. No input rows, no output rows.
    """
    spark = docs.sparkSession
    lines = written(spark, long_lines(docs, doc_id, text, min_chars), "lines")
    bounds = batch_bounds(lines, batches)
    runs = LineRuns(spark)
    above = None
    for bound in [*bounds, None]:
        part = lines if above is None else lines.where((F.col("doc") < above) | F.col("doc").isNull())
        runs.add(part if bound is None else part.where(F.col("doc") >= bound))
        above = bound
    frequent = written(spark, runs.frequent(min_docs), "frequent-lines")
    dropped = (
        lines.join(frequent, LINE)
        .where(~F.col("doc").eqNullSafe(F.col("keeper")))
        .groupBy("doc", "text_key")
        .agg(F.collect_set("place").alias("_places"))
        # Null ids meet too.
        .select(F.struct("doc").alias("_doc"), F.col("text_key").alias("_text_key"), "_places")
    )
    kept = [c for c in docs.columns if c not in names]
    rows = docs.select(*kept).withColumns(
        {"_doc": F.struct(F.col(doc_id).alias("doc")), "_text_key": text_key(F.col(text))}
    )
    whole = F.coalesce(F.col(text), F.lit(""))
    # The lines are named once and used twice, so that they are split once.
    split = rows.join(dropped, ["_doc", "_text_key"], "left").select(
        *kept, "_places", whole.alias("_whole"), F.split(whole, "\n").alias("_lines")
    )
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    shortened = F.array_join(F.transform(stays, lambda i: F.get("_lines", i)), "\n")
    return split.select(
        *kept,
        F.size("_lines").cast("long").alias(names[0]),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias(names[1]),
        F.when(F.col("_places").isNull(), F.col("_whole")).otherwise(shortened).alias(names[2]),
    )
