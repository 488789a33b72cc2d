"""Small helpers of the operators: column hygiene, folds, bounded samples, written tables, Arrow slices."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracelake.session import release as release
from tracelake.session import work_folder

# ASCII white space, as the contracts name it: blank and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Rows that a task turns into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)).cast("int")


def written(spark: SparkSession, df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared work folder: it is computed once and survives lost executors."""
    folder = work_folder(spark, label)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.parquet(folder)


def hand_back() -> None:
    """Give back what earlier tasks of this Python worker have freed, as the stages of a job share workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_sample(df: DataFrame, rows: int, key: Sequence[str]) -> DataFrame:
    """At most ``rows`` rows, chosen by a hash of ``key``, so alike on every run and every layout.

    The rows are thinned before the limit, so that the limit never moves much more than it keeps.
    """
    total = df.count()
    uniform = F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)
    thinned = df.withColumn("_u", uniform)
    if total > 2 * rows:
        thinned = thinned.where(F.col("_u") < 2.0 * rows / total)
    return thinned.orderBy("_u").limit(rows).drop("_u")


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most_bytes`` of text, or one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def batch_of(rows: Sequence[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch of these types."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


class Fold(Protocol):
    """What is known of a group after some of its rows."""

    def add(self, *row: object) -> None: ...

    def result(self) -> tuple: ...


def fold_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], new: Callable[[], Fold], out: str
) -> DataFrame:
    """One row per group: its keys, then ``out``, the schema of what the fold over its rows in order results in.

    A group's rows come sorted and one at a time, so a task holds one fold and one batch, whatever the group's size. Rows
    of a group are read by one task: for results that depend on all of its rows in sequence, like a digest. Null keys
    are keys like any other.
    """
    names, n_keys = [*keys, *values], len(keys)
    by = df.select(*names, *[F.col(c).alias(f"_order_{n}") for n, c in enumerate(order)])
    by = by.repartition(*keys).sortWithinPartitions(*keys, *[f"_order_{n}" for n in range(len(order))]).select(*names)
    schema = T.StructType([by.schema[k] for k in keys] + T.StructType.fromDDL(out).fields)
    kinds = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key, state = None, None

        for batch in slices(batches, 16 * SLICE_ROWS):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[:n_keys] != key:
                    if state is not None:
                        done.append((*key, *state.result()))
                    key, state = row[:n_keys], new()
                state.add(*row[n_keys:])
            if len(done) >= SLICE_ROWS:
                yield batch_of(done, kinds)
                done.clear()
        if state is not None:
            done.append((*key, *state.result()))
        if done:
            yield batch_of(done, kinds)

    return by.mapInArrow(fold, schema)
