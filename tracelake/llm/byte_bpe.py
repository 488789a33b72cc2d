"""Byte-level BPE as a tree reduction.

A text is cut in halves down to small leaves, the leaves are encoded on their own, and neighbours are joined: only a
window around the seam is encoded again, and the window grows until everything outside it is proven to stay.

Two facts carry the proofs.

* Scanning. A match of the split pattern depends on the text from its start to at most two characters behind its end.
  So the scan of a left half stays right up to its last three characters, and once a scan that crosses the seam meets
  a boundary of the right half's scan, both go on alike.
* Merging. A sequence of tokens is the encoding of its bytes if and only if every two neighbours are: up to the first
  merge across a seam, merges on both sides happen as they would alone. So a window may be set between two runs of
  tokens as soon as both its outer seams encode to just their two tokens.

The text before a blank that is followed by another character than white space never reaches over that blank, so leaves
are cut there first, and the pattern only runs on cuts that a worker has not seen yet.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelake.llm.merging import SHORT, ManyMerger, Merger
from tracelake.llm.scanning import PATTERN, Scanner, adapted_pattern, cuts, every_character
from tracelake.llm.shared import slices, text_slices

LEAF_CHARS = 8192
# Characters behind a match that can have decided it.
MARGIN = 3
DECODED_AT_ONCE = 4096
# Bytes of texts that are encoded at a time.
TEXTS_AT_ONCE = 1 << 21
# Matches that a worker remembers.
MATCHES_KEPT = 150_000
# A blank that may be part of a longer match of white space.
UNEVEN = re.compile(r" (?:\s|\Z)")
# So few matches are merged one by one.
MANY = 16


def tiktoken_pattern(pattern: str = PATTERN) -> str:
    """The pattern with the classes of the installed tiktoken library."""
    import tiktoken

    def members(name: str) -> set[str]:
        single = {bytes([b]): b for b in range(256)}
        found = tiktoken.Encoding("members", pat_str=name, mergeable_ranks=single, special_tokens={})
        return set(bytes(found.encode_ordinary(every_character())).decode())

    return adapted_pattern(pattern, members)


def read_ranks(ranks_path: str) -> dict[bytes, int]:
    with open(ranks_path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class RankEncoder:
    """Texts to ids by the ranks of a tiktoken file. Ids are little-endian 32-bit numbers in bytes."""

    def __init__(
        self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, remembered: int = MATCHES_KEPT
    ) -> None:
        self.ranks = read_ranks(ranks_path)
        self.leaf_chars = leaf_chars
        get = self.ranks.get
        self.merger = Merger(lambda a, b: get(a + b))
        # Any two tokens whose bytes together are a token can merge.
        pairs = {
            (self.ranks[t[:n]], self.ranks[t[n:]]): (rank, rank)
            for t, rank in self.ranks.items()
            for n in range(1, len(t))
            if t[:n] in self.ranks and t[n:] in self.ranks
        }
        self.many = ManyMerger([self.ranks[bytes([b])] for b in range(256)], pairs)
        self.scanner = Scanner(pattern, self._pieces, b"".join, remembered)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of matches. A match that is a token is that token, whatever the merges would make of it."""
        out, merged = [], {}
        for n, piece in enumerate(pieces):
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out.append(whole.to_bytes(4, "little"))
            elif len(data) <= SHORT and len(pieces) >= MANY:
                out.append(b"")
                merged[n] = data
            else:
                out.append(b"".join(self.ranks[t].to_bytes(4, "little") for t in self.merger.encode(data)))
        if merged:
            rows, sizes = self.many.merge(list(merged.values()))
            packed, width = rows.astype("<i4").tobytes(), 4 * rows.shape[1]
            for row, (n, size) in enumerate(zip(merged, sizes.tolist())):
                out[n] = packed[row * width : row * width + 4 * size]
        return out

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Short texts are cut at their blanks together, and each distinct cut is looked up once."""
        plain = [n for n, t in enumerate(texts) if t and len(t) <= self.leaf_chars and not UNEVEN.search(t)]
        rest = set(range(len(texts))).difference(plain)
        units = {n: cuts(texts[n]) if "\0" not in texts[n] else [] for n in rest}
        self.scanner.learn(set().union(*units.values()))
        out = {n: self.encode(texts[n], parts) for n, parts in units.items()}
        out |= zip(plain, self._plain([texts[n] for n in plain]))
        return [out[n] for n in range(len(texts))]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of texts in which every blank starts a match."""
        if not texts:
            return []
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        starts = lists.offsets.to_numpy()
        words = lists.values.dictionary_encode()
        cut = [" " + word for word in words.dictionary.to_pylist()]
        # The first word of a text has no blank before it.
        first = lists.values.take(pa.array(starts[:-1])).to_pylist()
        at = words.indices.to_numpy().copy()
        at[starts[:-1]] = np.arange(len(cut), len(cut) + len(first))
        # A word that only starts texts is no cut, but does no harm as one.
        values = list(map(self.scanner.cuts.get, cut))
        # What starts a text may be empty or white space, which is no cut.
        cut_of = [c for c, v in zip(cut, values) if v is None and len(c) > 1 and not c[1].isspace()]
        self.scanner.learn(set(cut_of))
        known = self.scanner.cuts
        new = dict(zip(cut_of, map(known.__getitem__, cut_of)))
        found = [new.get(c, b"") if v is None else v for c, v in zip(cut, values)]
        ids = pa.array(found + [known[word] if word else b"" for word in first], pa.large_binary()).take(pa.array(at))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[starts].tolist()
        data = memoryview(ids.buffers()[2])
        return [bytes(data[start:stop]) for start, stop in zip(ends, ends[1:])]

    def encode(self, text: str, units: list[str] | None = None) -> bytes:
        if len(text) <= self.leaf_chars:
            return b"".join(self.scanner.units(text, units)[1])
        return b"".join(self._tree(text)[1])

    def _tree(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= self.leaf_chars:
            return self.scanner.units(text)
        half = len(text) // 2
        return self._join(self._tree(text[:half]), self._tree(text[half:]))

    def _join(self, left, right) -> tuple[list[str], list[bytes]]:
        (left_units, left_ids), (right_units, right_ids) = left, right
        start, tail = len(left_units), ""
        while start and len(tail) < MARGIN:
            start -= 1
            tail = left_units[start] + tail
        grow = 1
        while True:
            window, ends = tail, {}
            for n, unit in enumerate(right_units[:grow]):
                window += unit
                ends[len(window)] = n + 1
            whole = grow >= len(right_units)
            pieces, at, rest = [], 0, None
            for piece in self.scanner.pattern.findall(window):
                pieces.append(piece)
                at += len(piece)
                if at in ends and at <= len(window) - MARGIN:
                    rest = ends[at]
                    break
            if rest is not None or whole:
                rest = len(right_units) if rest is None else rest
                ids = list(map(self.scanner.pieces.__getitem__, pieces))
                return left_units[:start] + pieces + right_units[rest:], left_ids[:start] + ids + right_ids[rest:]
            grow *= 2


@lru_cache(2)
def vocabulary(ranks_path: str) -> pa.Array:
    """The bytes of every id; null for a number that is none."""
    entries = {i: t for t, i in read_ranks(ranks_path).items()}
    return pa.array([entries.get(n) for n in range(max(entries) + 1)], pa.large_binary())


def concatenated(tokens: pa.Array, start: int, stop: int) -> bytes:
    """The bytes of the tokens from ``start`` to ``stop``: both halves, joined. Leaves are one stretch of their bytes."""
    if stop - start <= DECODED_AT_ONCE:
        at = np.frombuffer(tokens.buffers()[1], np.int64)
        return tokens.buffers()[2][int(at[start]) : int(at[stop])].to_pybytes() if stop > start else b""
    half = (start + stop) // 2
    return concatenated(tokens, start, half) + concatenated(tokens, half, stop)


def decoded(vocabulary: pa.Array, ids: pa.ListArray) -> list[bytes]:
    """The bytes of each list of ids. All ids are looked up at once."""
    tokens = vocabulary.take(ids.flatten())
    if tokens.null_count:
        raise ValueError("an id is not in the vocabulary")
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(ids), 0).to_pylist()]).tolist()
    return [concatenated(tokens, start, stop) for start, stop in zip(ends, ends[1:])]


@lru_cache(2)
def rank_encoder(ranks_path: str, pattern: str, remembered: int) -> RankEncoder:
    """One encoder per worker, so that tasks that follow know the words of those before."""
    return RankEncoder(ranks_path, pattern, remembered=remembered)


def _with(df: DataFrame, column: str, kind: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name != column]
    return T.StructType([*kept, T.StructField(column, kind)])


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str | None = None,
    text: str = "text",
    out: str = "token_ids",
    remembered: int = MATCHES_KEPT,
) -> DataFrame:
    """Add ``out``: the ids of the whole ``text`` as an array of int. A null text counts as empty: no ids.

    A column that already has the name ``out`` is replaced; every other column is kept. Rows keep their partition.
    ``pattern`` splits texts; by default the public one, with the character classes of the installed library. A worker
    remembers ``remembered`` matches, also for the jobs that follow.
    """
    pattern = tiktoken_pattern() if pattern is None else pattern
    schema = _with(docs, out, T.ArrayType(T.IntegerType(), False))
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path, pattern, remembered)
        for part in text_slices(batches, text, TEXTS_AT_ONCE):
            ids = encoder.encode_many([x or "" for x in part.column(text).to_pylist()])
            ends = np.cumsum([0, *map(len, ids)]) // 4
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"), pa.int32())
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), column], [*names, out])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the ids in ``ids`` stand for. No ids or a null give no bytes.

    ``ids`` itself is dropped, and a column with the name ``out`` is replaced. Ids outside the vocabulary are an error.
    """
    schema = _with(tokens.drop(ids), out, T.BinaryType())
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary(ranks_path)
        for part in slices(batches):
            data = decoded(tokens, part.column(ids))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(n) for n in names), pa.array(data, pa.binary())], [*names, out]
            )

    return tokens.mapInArrow(run, schema)
