"""Token ids in training order: fixed-stride shards of a keyed permutation of all sequences.

Every document's ids are cut into sequences of a fixed length. Sequences are numbered without gaps, and a keyed Feistel
network with cycle-walking maps each number to a global slot: a permutation that needs no shuffle table and can be
inverted. Ranges of slots are shards; each shard is written by one task in slot order with records of one size, so the
training order is read from front to back, and a reader goes on at any slot.

A shard is a Parquet file of one row, as any store that Spark reads can hold it and a lost task is written again as a
whole: its records lie in one binary value at a fixed stride, with the document, sequence and token number of each beside
it. Ids are those of the tiktoken library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.byte_bpe import read_ranks
from tracelake.llm.scanning import PATTERN
from tracelake.llm.shared import slices, written
from tracelake.session import work_folder

SEQUENCE_TOKENS = 512
SHARD_SLOTS = 8192
ROUNDS = 6
COMPRESSION = "zstd"
# Bytes of an id in a record.
ID_BYTES = 2


class Permutation:
    """A keyed permutation of 0 to ``n`` - 1, for many numbers at once."""

    def __init__(self, n: int, key: int) -> None:
        self.n = n
        # Two digits of base ``side``: the network permutes at least ``n`` numbers, and not many more.
        self.side = np.uint64(max(1, isqrt(max(0, n - 1)) + 1))
        self.keys = np.random.default_rng(key).integers(1, 1 << 63, ROUNDS, dtype=np.uint64)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(32))

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x // self.side, x % self.side
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = (right + self.side - self._mixed(left, key) % self.side) % self.side, left
            else:
                left, right = right, (left + self._mixed(right, key) % self.side) % self.side
        return left * self.side + right

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        out = self._network(np.asarray(numbers).astype(np.uint64), back)
        # Numbers that land behind the end go on along their cycle until they are inside.
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._network(out[outside], back)
        return out.astype(np.int64)

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


@lru_cache(2)
def encoding(ranks_path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens={})


def _packed(docs: DataFrame, ranks_path: str, sequence_tokens: int, id_bytes: int) -> DataFrame:
    """(doc, n_tokens, sequences, sequences before it in its part, ids as bytes) of documents with tokens."""
    schema = T.StructType([docs.schema["doc"], *T.StructType.fromDDL("n_tokens long, sequences long, first long, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, before = encoding(ranks_path), 0
        for batch in slices(batches):
            ids = [np.array(library.encode_ordinary(t or ""), np.int64) for t in batch.column("text").to_pylist()]
            if max((int(x.max()) for x in ids if x.size), default=0) >= 1 << (8 * id_bytes):
                raise ValueError("an id does not fit into id_bytes")
            sizes = np.array([len(x) for x in ids], np.int64)
            sequences = -(-sizes // sequence_tokens)
            first = before + np.cumsum(sequences) - sequences
            before += int(sequences.sum())
            data = [x.astype(f"<u{id_bytes}").tobytes() for x in ids]
            columns = [batch.column("doc"), pa.array(sizes), pa.array(sequences), pa.array(first), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names).filter(pa.array(sizes > 0))

    return docs.mapInArrow(run, schema)


def write_shards(
    docs: DataFrame,
    ranks_path: str,
    folder: str,
    key: int,
    doc_id: str = "doc_id",
    text: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    shard_slots: int = SHARD_SLOTS,
    pad: int = 0,
    id_bytes: int = ID_BYTES,
) -> int:
    """Encode ``docs`` and write their sequences to ``folder`` in training order; the number of sequences.

    Texts are split by the public pattern. A document's last sequence is filled up with ``pad`` ids; ``n_tokens`` of a record counts the real ones. Documents
    with null or empty texts have no sequences. Sequences are numbered in the order in which Spark reads the rows, so the
    same files and the same splits give the same order; rows that repeat a document have their own sequences. Other
    columns are not looked at. Without sequences an empty table is written.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"))
    packed = _packed(rows, ranks_path, sequence_tokens, id_bytes).withColumn("part", F.spark_partition_id())
    # Numbers of parts are those of this write; later steps only read them.
    packed = written(spark, packed, "packed", COMPRESSION)
    parts = packed.groupBy("part").agg(F.sum("sequences").alias("sequences"))
    total = parts.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]
    # One row per part of the write: its tasks bound it, and Spark holds more about each of them than these two numbers.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("sequences").over(before), F.lit(0)).alias("start"))
    numbered = packed.join(F.broadcast(starts), "part").select("doc", "n_tokens", (F.col("start") + F.col("first")).alias("number"), "ids")
    shards = max(1, ceil(total / shard_slots))
    records = _records(numbered, Permutation(total, key), sequence_tokens, pad.to_bytes(id_bytes, "little"))
    records = records.withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("int"))
    # A task per shard.
    dealt = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")
    _strided(dealt, sequence_tokens * id_bytes).write.option("compression", COMPRESSION).parquet(folder)
    return total


def _strided(records: DataFrame, stride: int) -> DataFrame:
    """One row per shard: its records as one value, the record of its slot ``first_slot + i`` at byte ``i * stride``."""
    kind = records.schema["doc"].dataType.simpleString()
    schema = T.StructType.fromDDL(
        f"shard int, first_slot long, stride int, docs array<{kind}>, sequences array<int>, n_tokens array<int>, data binary"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            lists = [pa.array([whole.column(c).to_pylist()], pa.list_(whole.schema.field(c).type)) for c in ("doc", "sequence", "n_tokens")]
            data = b"".join(x for column in whole.column("record").chunks for x in column.to_pylist())
            first = [whole.column(c)[0].as_py() for c in ("shard", "slot")]
            numbers = [pa.array([first[0]], pa.int32()), pa.array([first[1]]), pa.array([stride], pa.int32())]
            return pa.RecordBatch.from_arrays([*numbers, *lists, pa.array([data], pa.binary())], schema.names)

        for batch in batches:
            of = batch.column("shard").to_numpy()
            for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(of)) + 1) if len(of) else []:
                if held and held[0].column("shard")[0].as_py() != of[part[0]]:
                    yield shard()
                    held.clear()
                held.append(batch.slice(part[0], len(part)))
        if held:
            yield shard()

    return records.mapInArrow(run, schema)


def _records(numbered: DataFrame, permutation: Permutation, sequence_tokens: int, filler: bytes) -> DataFrame:
    """(slot, doc, sequence, n_tokens, record): one row per sequence, with its little-endian ids."""
    kind = numbered.schema["doc"].dataType.simpleString()
    stride = len(filler) * sequence_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first = (batch.column(c).to_numpy() for c in ("n_tokens", "number"))
            sequences = -(-sizes // sequence_tokens)
            row = np.repeat(np.arange(len(sizes)), sequences)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(sequences) - sequences, sequences)
            slots = permutation.slots(first[row] + sequence)
            real = np.minimum(sizes[row] - sequence * sequence_tokens, sequence_tokens)
            data = batch.column("ids").to_pylist()
            records = [data[r][s * stride : (s + 1) * stride] for r, s in zip(row.tolist(), sequence.tolist())]
            records = [x + filler * ((stride - len(x)) // len(filler)) for x in records]
            columns = [
                pa.array(slots),
                batch.column("doc").take(pa.array(row)),
                pa.array(sequence.astype(np.int32)),
                pa.array(real.astype(np.int32)),
                pa.array(records, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["slot", "doc", "sequence", "n_tokens", "record"])

    schema = f"slot long, doc {kind}, sequence int, n_tokens int, record binary"
    return numbered.mapInArrow(run, schema)


def read_from(spark: SparkSession, folder: str, slot: int = 0) -> DataFrame:
    """The records from ``slot`` on. Shards before it are skipped by the statistics of their files; inside of one, a record
    is the stretch of its bytes that its place times the stride names."""
    shards = spark.read.parquet(folder)
    places = F.sequence(F.greatest(F.lit(0), F.lit(slot) - F.col("first_slot")), F.size("docs").cast("long") - 1)
    behind = shards.where(F.col("first_slot") + F.size("docs") > slot).withColumn("_at", F.explode(places))
    at = F.col("_at").cast("int")
    return behind.select(
        (F.col("first_slot") + F.col("_at")).alias("slot"),
        F.get("docs", at).alias("doc"),
        F.get("sequences", at).alias("sequence"),
        F.get("n_tokens", at).alias("n_tokens"),
        F.substring("data", at * F.col("stride") + 1, F.col("stride")).alias("record"),
        "shard",
    )


def shard_folder(spark: SparkSession) -> str:
    return work_folder(spark, "token-shards")
