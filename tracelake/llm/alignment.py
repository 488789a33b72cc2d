"""Tokens of two tokenizers aligned over the same bytes, by diagonal run skipping, with counts of all linked id pairs.

A text is encoded twice. Byte offsets at which tokens of both end cut the tokens into groups, and tokens whose byte ranges
overlap are linked. The arrays of end offsets are compared at the current index shift by list slices of doubling width,
so stretches of one-to-one groups are jumped over; where the ends differ, the group is closed token by token, which gives
the next shift. Stretches between blanks that no token spans are aligned once and remembered, see ``Pair``.

Links are counted over the corpus by id pair. A chunk, some megabytes of texts of one task, keeps its distinct pairs in a
dictionary and its documents' links as numbers in it. Dictionaries are summed up by pair, and the sums go back to their
chunks: what is moved are pairs per chunk, not links. A pair that holds a third of all links is one row per chunk, and
no chunk is larger than ``CHUNK_BYTES`` and one text.

Texts that are null or empty, or whose tokens of either side do not join to the bytes of blank and text, have no tokens:
all numbers are 0 and the groups are an empty text. Rows may repeat; each is a document of its own. Columns are kept
except the text; a column named like a result gives way to it. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.shared import text_slices, written

CHUNK_BYTES = 1 << 22
# Units that are encoded at a time, and characters of units that a worker remembers before it starts anew.
UNITS_AT_ONCE = 1 << 14
CHARS_KEPT = 1 << 23
# Where texts come apart: at a blank behind a visible character, unless it is the last character. A text without the other
# pattern, blank put before, comes apart at all its blanks.
SEAM = re.compile(r"(?<=\S) (?!\Z)")
UNEVEN = re.compile(r"\s |\s\Z")
# Characters that a normalizer would change.
PROBE = "\ufb01\u00bd  \u212b\n\u3000A"
# Widest slice that is compared before anything is known about a stretch.
FIRST_PROBE = 4
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*NUMBERS, "n_best", "count_sum", "groups_sha256", "groups")


def close_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of each group on both sides. Both arrays rise and have the same last value."""
    a, b = ends_a.tolist(), ends_b.tolist()
    n = len(a)
    runs: list[tuple[int, int, int]] = []
    i = j = 0
    while i < n:
        # One-to-one stretch: double the compared width while the slices agree, then halve it around the first difference.
        start, width = i, FIRST_PROBE
        while a[i : i + width] == b[j : j + width] and i < n:
            i, j, width = i + width, j + width, 2 * width
        while width:
            if i < n and a[i : i + width] == b[j : j + width]:
                i, j = i + width, j + width
            width >>= 1
        if i >= n:
            # Slices end with the lists: the stretch reaches the end.
            j -= i - n
            i = n
        if i > start:
            runs.append((start, j - (i - start), i - start))
        if i < n:
            end_a, end_b = a[i], b[j]
            while end_a != end_b:
                if end_a < end_b:
                    i += 1
                    end_a = a[i]
                else:
                    j += 1
                    end_b = b[j]
            runs.append((i, j, 1))
            i, j = i + 1, j + 1
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first_a, first_b, sizes = np.array(runs, np.int64).T
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(first_a, sizes) + within, np.repeat(first_b, sizes) + within


def links(ends_a: np.ndarray, ends_b: np.ndarray, last_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of every link, in order: each end of either side closes the overlap of one pair."""
    inner = np.ones(len(ends_b), bool)
    inner[last_b] = False
    # The end of a group is one of A and of B; 1 marks an end of A, 2 one of B.
    both = np.zeros(len(ends_b), bool)
    both[last_b] = True
    at_both = np.isin(ends_a, ends_b[both], assume_unique=True)
    marks = np.sort(np.concatenate([ends_a * 4 + np.where(at_both, 3, 1), ends_b[inner] * 4 + 2]), kind="stable")
    of_a, of_b = marks & 1, (marks >> 1) & 1
    return np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else one above 255."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in printing]
    return {chr(byte): byte for byte in printing} | {chr(256 + n): byte for n, byte in enumerate(others)}


class Side:
    """A tokenizer with the bytes of each id. ``splits``: no token spans a visible character and a blank behind it."""

    def __init__(self, path: str) -> None:
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
            self.bytes = [self._piece(p) for p in pieces]
            self.encode = self._pieces
            inner = any("▁" in p.lstrip("▁") for p in pieces)
            self.splits = not inner and self.joined(self.encode([PROBE])[0]) == f" {PROBE}".encode()
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer, pre_tokenizers

            self.model = Tokenizer.from_file(path)
            self.model.encode_special_tokens = True
            at = byte_characters()
            entries = self.model.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(entries.values()) + 1)
            for entry, n in entries.items():
                self.bytes[n] = bytes(at[c] for c in entry) if all(c in at for c in entry) else entry.encode()
            self.encode = self._entries
            # This splitter cuts behind visible characters that white space follows.
            split = self.model.pre_tokenizer
            self.splits = self.model.normalizer is None and isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex
        self.sizes = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        # The model puts the blank before a text itself.
        return self.model.encode(texts, num_threads=1)

    def _entries(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Pair:
    """Two tokenizers, and what is known of the units that texts are made of.

    A unit is a blank and what follows it up to the next blank behind a visible character. No token of either side spans
    such a place (``Side.splits``), so a unit has the same tokens, groups and links in every text. Its alignment is
    worked out once, and texts are put together from their units. If a side may span blanks, a text is one unit.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = Side(path_a), Side(path_b)
        self.splits = self.a.splits and self.b.splits
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        shown = [f"{n}{c}" for c, size in ((",", n_a), ("|", n_a), (",", n_b), (";", n_b)) for n in range(size)]
        self.shown = pa.array(shown, pa.large_string())
        self.starts = np.cumsum([0, n_a, n_a, n_b])
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        # By unit: n_a, n_b, n_groups, n_links, or zeros where the bytes differ; the groups, None where the bytes differ.
        self.numbers = np.zeros((0, len(NUMBERS)), np.int64)
        self.groups: list[bytes | None] = []
        # Numbers of the pairs of all units' links, one after the other, and the pair of each number.
        self.links = np.zeros(0, np.int32)
        self.pairs: dict[int, int] = {}

    def units(self, text: str) -> list[str]:
        """The units of blank and text, without the blank they start with."""
        if not self.splits:
            return [text]
        return SEAM.split(text) if UNEVEN.search(f" {text}") else text.split(" ")

    def learn(self, units: set[str]) -> None:
        new = list(units.difference(self.index))
        if not new:
            return
        ids, sound = ([], []), []
        for start in range(0, len(new), UNITS_AT_ONCE):
            some = new[start : start + UNITS_AT_ONCE]
            for unit, a, b in zip(some, self.a.encode(some), self.b.encode(some)):
                whole = b" " + unit.encode("utf-8", "surrogatepass")
                sound.append(self.a.joined(a) == whole == self.b.joined(b))
                for side, found in zip(ids, (a, b)):
                    side.append(np.array(found if sound[-1] else [], np.int64))
        id_a, id_b = (np.concatenate(x) for x in ids)
        # Ends run on over all units; units end on both sides, so groups never span two of them.
        ends_a, ends_b = np.cumsum(self.a.sizes[id_a]), np.cumsum(self.b.sizes[id_b])
        last_a, last_b = close_groups(ends_a, ends_b)
        link_a, link_b = links(ends_a, ends_b, last_b)
        to_a, to_b = (np.cumsum([len(x) for x in side]) for side in ids)
        to = np.stack([to_a, to_b, np.searchsorted(last_a, to_a), np.searchsorted(link_a, to_a)], axis=1)
        codes, numbers = np.unique(id_a[link_a] * len(self.b.bytes) + id_b[link_b], return_inverse=True)
        known = np.array([self.pairs.setdefault(c, len(self.pairs)) for c in codes.tolist()], np.int32)
        self.links = np.concatenate([self.links, known[numbers] if len(codes) else np.zeros(0, np.int32)])
        self.numbers = np.concatenate([self.numbers, np.diff(to, axis=0, prepend=0)])
        shown = self._shown(id_a, id_b, last_a, last_b, to_a + to_b)
        self.groups += [text if ok else None for text, ok in zip(shown, sound)]
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        self.chars += sum(map(len, new))

    def _shown(self, id_a, id_b, last_a, last_b, to) -> Iterator[bytes]:
        """The groups of each unit as text. All ids are put in order at once, so a unit's are one stretch of bytes."""
        end_a, end_b = (np.zeros(len(x), bool) for x in (id_a, id_b))
        end_a[last_a], end_b[last_b] = True, True
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        first_b = np.concatenate([[0], last_b + 1])
        order = np.zeros(len(id_a) + len(id_b), np.int64)
        order[np.arange(len(id_a)) + first_b[group_a]] = id_a + self.starts[end_a.astype(int)]
        order[np.arange(len(id_b)) + last_a[group_b] + 1] = id_b + self.starts[2 + end_b.astype(int)]
        texts = self.shown.take(pa.array(order))
        at = np.frombuffer(texts.buffers()[1], np.int64)[np.concatenate([[0], to])].tolist()
        data = memoryview(texts.buffers()[2])
        return (bytes(data[start:end]) for start, end in zip(at, at[1:]))

    def chunk(self, texts: list[str | None]) -> dict:
        """Numbers, groups and links of the documents, and the dictionary of their id pairs."""
        if self.chars > CHARS_KEPT:
            self.forget()
        units = [self.units(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(units)))
        of = [np.fromiter(map(self.index.__getitem__, u), np.int64, len(u)) for u in units]
        groups = []
        for n, numbers in enumerate(of):
            parts = list(map(self.groups.__getitem__, numbers.tolist()))
            if None in parts:
                parts, of[n] = [], of[n][:0]
            groups.append(b"".join(parts)[:-1])
        every = np.concatenate(of)
        owner = np.repeat(np.arange(len(of)), [len(x) for x in of])
        sums = np.zeros((len(of), len(NUMBERS)), np.int64)
        for k in range(len(NUMBERS)):
            # Sums of whole numbers below 2 ** 53 are exact.
            sums[:, k] = np.bincount(owner, self.numbers[every, k], len(of))
        sizes = self.numbers[every, 3]
        first = np.cumsum(self.numbers[:, 3]) - self.numbers[:, 3]
        at = np.arange(sizes.sum()) + np.repeat(first[every] - (np.cumsum(sizes) - sizes), sizes)
        linked = self.links[at]
        counts = np.bincount(linked, minlength=len(self.pairs))
        used = np.flatnonzero(counts)
        number = np.zeros(len(self.pairs), np.int32)
        number[used] = np.arange(len(used))
        pairs = np.fromiter(self.pairs, np.int64, len(self.pairs))
        return dict(zip(NUMBERS, sums.T)) | {
            "groups": groups,
            "links": np.split(number[linked], np.cumsum(sums[:-1, 3])),
            "pairs": pairs[used],
            "counts": counts[used],
        }


@lru_cache(4)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def encoded_chunks(docs: DataFrame, path_a: str, path_b: str, text: str, with_groups: bool) -> DataFrame:
    """Documents with their links as numbers in the dictionary of their chunk, and one row per dictionary."""
    kept = [c for c in docs.columns if c != text and c not in RESULTS]
    row = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_none"))
    rows = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("row", rows.schema["row"].dataType),
            *[T.StructField(name, T.LongType()) for name in NUMBERS],
            T.StructField("groups_sha256", T.StringType()),
            T.StructField("groups", T.StringType()),
            T.StructField("links", T.BinaryType()),
            T.StructField("pairs", T.ArrayType(T.LongType())),
            T.StructField("counts", T.ArrayType(T.LongType())),
        ]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        number = TaskContext.get().partitionId() << 33
        for part in text_slices(batches, "text", CHUNK_BYTES):
            found = pair.chunk(part.column("text").to_pylist())
            n = part.num_rows
            none, kind = pa.nulls(n, pa.list_(pa.int64())), part.column("row").type
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, number)),
                    part.column("row"),
                    *[pa.array(found[name]) for name in NUMBERS],
                    pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]]),
                    pa.array([bytes(g or b"").decode() for g in found["groups"]]) if with_groups else pa.nulls(n, pa.string()),
                    pa.array([x.tobytes() for x in found["links"]], pa.binary()),
                    none,
                    none,
                ],
                names=schema.names,
            )
            dictionary = [pa.array([found[c]], pa.list_(pa.int64())) for c in ("pairs", "counts")]
            empty = [pa.nulls(1, t) for t in (kind, *[pa.int64()] * 4, pa.string(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *empty, *dictionary], names=schema.names)
            number += 1

    return rows.mapInArrow(encode, schema)


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, count) of the corpus: partial sums per task, then one row per pair that occurs."""
    entries = chunks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("_e"))
    return entries.groupBy(F.col("_e.pairs").alias("pair")).agg(F.sum("_e.counts").alias("count"))


def align(
    spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, text: str = "text", with_groups: bool = False
) -> DataFrame:
    """Documents with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``path_a`` and ``path_b`` name tokenizer files (.json, or .model of pieces). ``n_best`` counts the links whose pair
    has the highest count of all pairs of its B id, ties included; ``count_sum`` adds up the counts of all links.
    ``with_groups`` also returns the groups themselves: ``a1,a2|b1;a3|b2``.
    """
    chunks = written(spark, encoded_chunks(docs, path_a, path_b, text, with_groups), "alignment")
    counts = written(spark, pair_counts(chunks), "alignment-pairs")
    n_b = len(pair_of(path_a, path_b).b.bytes)
    # One row per id of a vocabulary, whatever the size of the corpus.
    best = F.broadcast(counts.groupBy((F.col("pair") % n_b).alias("id_b")).agg(F.max("count").alias("best")))
    known = counts.join(best, F.col("pair") % n_b == F.col("id_b")).select(
        "pair", "count", (F.col("count") == F.col("best")).alias("is_best")
    )
    entries = chunks.where("pairs is not null").select("chunk", F.posexplode("pairs").alias("number", "pair"))
    weights = entries.join(known, "pair").select(F.col("chunk").alias("of"), "number", "count", "is_best")
    docs_of = chunks.where("row is not null").drop("pairs", "counts")
    kept = [f for f in docs_of.schema["row"].dataType.fields if f.name != "_none"]
    schema = T.StructType(
        [
            docs_of.schema["row"],
            *[T.StructField(name, T.LongType()) for name in (*NUMBERS, "n_best", "count_sum")],
            T.StructField("groups_sha256", T.StringType()),
            *([T.StructField("groups", T.StringType())] if with_groups else []),
        ]
    )
    names = schema.names

    def weigh(of_chunk: pa.Table, weights_of: pa.Table) -> pa.Table:
        number = weights_of.column("number").to_numpy()
        count, is_best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number] = weights_of.column("count").to_numpy()
        is_best[number] = weights_of.column("is_best").to_numpy(zero_copy_only=False)
        found = [np.frombuffer(x.as_py(), np.int32) for x in of_chunk.column("links")]
        sums = {
            "n_best": pa.array([int(is_best[x].sum()) for x in found], pa.int64()),
            "count_sum": pa.array([int(count[x].sum()) for x in found], pa.int64()),
        }
        return pa.table([sums[name] if name in sums else of_chunk.column(name) for name in names], names=names)

    weighed = docs_of.groupBy("chunk").cogroup(weights.groupBy("of")).applyInArrow(weigh, schema)
    return weighed.select(*[F.col("row")[f.name].alias(f.name) for f in kept], *names[1:])
