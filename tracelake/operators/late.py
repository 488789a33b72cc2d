"""Late fetch: rows are chosen on a few numbers, and only the chosen ones bring their wide columns.

A row of a file has an address: the number of its file and its place there, as one number (``FileRows``). A choice,
like the first frame of each function or the last frame of a trace, is then an aggregate over numbers, which stays a hash
aggregate with a row per group on the map side, and reads only the columns it goes by. ``fetch_rows`` reads the rest of
the chosen rows where they lie: a scan drops all other rows against the broadcast addresses of its own files, so wide rows
are never sorted or shuffled. The addresses of a round of files have at most ``ROUND_ROWS`` rows; with more, files are
read in several rounds, each once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.session import work_folder

ADDRESS = "row_address"
# A file has fewer rows than this power of two.
PLACE_BITS = 40
# Addresses that are broadcast at a time: some 16 bytes each.
ROUND_ROWS = 1 << 22

Rows = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class FileRows:
    """Rows as read from Parquet files, the sorted paths of those, and what makes the rows that are worked on.

    ``build`` takes the raw rows with their address and has to keep it, row by row.
    """

    raw: DataFrame
    paths: tuple[str, ...]
    build: Rows

    def rows(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The built rows of the files from number ``first`` to ``last``, with their address. Other files are not read."""
        path = F.col("_metadata.file_path")
        last = len(self.paths) - 1 if last is None else last
        numbers = self.raw.sparkSession.createDataFrame(
            list(enumerate(self.paths))[first : last + 1], "_number long, _path string"
        )
        raw = self.raw if (first, last) == (0, len(self.paths) - 1) else self.raw.where(path.between(self.paths[first], self.paths[last]))
        placed = raw.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_place"))
        place = F.shiftleft(F.col("_number"), PLACE_BITS).bitwiseOR(F.col("_place"))
        # One row per file; the driver lists the same files to plan the scan.
        addressed = placed.join(F.broadcast(numbers), "_path").withColumn(ADDRESS, place)
        return self.build(addressed.select(*self.raw.columns, ADDRESS))


def file_rows(raw: DataFrame, build: Rows = lambda rows: rows) -> FileRows:
    """``raw`` has to come from ``spark.read.parquet`` without any step in between."""
    paths = raw.select(F.col("_metadata.file_path").alias("path")).distinct().collect()
    return FileRows(raw, tuple(sorted(r["path"] for r in paths)), build)


def first_of(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The address of the first row of each group. Ties are any one row."""
    return rows.groupBy(*keys).agg(F.min_by(ADDRESS, order).alias(ADDRESS)).select(ADDRESS)


def last_of(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The address of the last row of each group."""
    return rows.groupBy(*keys).agg(F.max_by(ADDRESS, order).alias(ADDRESS)).select(ADDRESS)


def fetch_rows(table: FileRows, chosen: DataFrame, round_rows: int = ROUND_ROWS) -> DataFrame:
    """The rows of ``table`` whose address is in ``chosen``, without the address.

    The choice is made at once and its addresses are written; they are counted by file, one row per file on the driver. If all of it fits into one round the result is a plan;
    else each round is written to the work folder, and the result reads that table.
    """
    spark: SparkSession = table.raw.sparkSession
    chosen = stored(chosen.select(ADDRESS), "addresses")
    counts = chosen.groupBy(_file().alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    rounds = _rounds({r["file"]: r["n"] for r in counts}, round_rows)
    if len(rounds) < 2:
        return _met(table.rows(*(rounds[0] if rounds else (0, None))), chosen)
    path = work_folder(spark, "late-rows")
    for first, last in rounds:
        _met(table.rows(first, last), chosen.where(_file().between(first, last))).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def stored(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a table in the work folder: worked out once for all that reads it."""
    path = work_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _met(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(chosen.select(ADDRESS)), ADDRESS, "left_semi").drop(ADDRESS)


def _file() -> Column:
    return F.shiftright(F.col(ADDRESS), PLACE_BITS)


def _rounds(counts: dict[int, int], most: int) -> list[tuple[int, int]]:
    """Ranges of files with at most ``most`` chosen rows each, or one file."""
    rounds: list[list[int]] = []
    held = most
    for file in sorted(counts):
        if held + counts[file] > most:
            rounds.append([file, file])
            held = 0
        rounds[-1][1] = file
        held += counts[file]
    return [(first, last) for first, last in rounds]
