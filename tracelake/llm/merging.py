"""Byte-pair merging: one long piece at a time, or many short pieces at once in numpy."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Mapping, Sequence

import numpy as np

NEVER = 1 << 40
# Pieces up to this many bytes are merged many at once.
SHORT = 32
# Longer keys are not remembered, and twice so many are at most.
REMEMBERED_CHARS = 64
REMEMBERED = 150_000


class Remembered(dict):
    """What ``find`` gives for a key, in two generations: a full one makes way, but what is asked again stays."""

    def __init__(self, find: Callable, most: int = REMEMBERED) -> None:
        super().__init__()
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.find(key)
        if len(key) <= REMEMBERED_CHARS:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value

    def unseen(self, keys: Iterable) -> set:
        """The keys that have to be found. Those of the older generation move up."""
        new = keys.difference(self) if isinstance(keys, set) else set(keys).difference(self)
        # A look-up per key: an intersection would walk through all that is remembered.
        known = [key for key in new if key in self.older]
        for key, value in zip(known, list(map(self.older.__getitem__, known))):
            self.keep(key, value)
        new.difference_update(known)
        return new


class Merger:
    """Merges of one vocabulary: ``rank`` gives the rank of two neighbours, or None if they stay apart."""

    def __init__(self, rank: Callable[[bytes, bytes], int | None]) -> None:
        self.rank = rank
        self.pairs = Remembered(lambda pair: self.merge(pair[0] + pair[1]) == list(pair))

    def encode(self, data: bytes) -> list[bytes]:
        """The tokens of ``data``: halves are encoded on their own and joined."""
        if len(data) <= SHORT:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The tokens of the joined bytes: the window at the seam grows until both its outer seams hold.

        A seam holds if its two tokens, merged on their own, are just those two. A sequence whose seams all hold is the
        encoding of its bytes: up to the first merge across a seam, both sides merge as they would alone.
        """
        grow = 1
        while True:
            start, end = max(0, len(left) - grow), min(len(right), grow)
            window = self.merge(b"".join(left[start:] + right[:end]))
            if (start == 0 or self.pairs[left[start - 1], window[0]]) and (
                end == len(right) or self.pairs[window[-1], right[end]]
            ):
                return left[:start] + window + right[end:]
            grow *= 2

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging: always the neighbours of the lowest rank, the first of equals."""
        rank, parts = self.rank, [data[i : i + 1] for i in range(len(data))]
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i], parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or parts[i] != a or parts[j] != b:
                continue  # one of the two has been merged meanwhile
            parts[i], parts[j] = a + b, b""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(parts[i], parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := rank(parts[h], parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]


class Numbers:
    """A map from whole numbers to whole numbers, asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        open_, at = np.arange(len(keys)), self._at(keys)
        while open_.size:
            free = self.keys[at[open_]] == -1
            self.keys[at[open_[free]]] = keys[open_[free]]
            open_ = open_[self.keys[at[open_]] != keys[open_]]
            at[open_] = (at[open_] + 1) & self.mask
        self.values[at] = values

    def _at(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        out, at = np.full(keys.shape, missing, np.int64), self._at(keys)
        open_ = np.arange(keys.size)
        while open_.size:
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            at[open_] = (at[open_] + 1) & self.mask
        return out


class ManyMerger:
    """Merges many short pieces at once. ``pairs`` maps two ids to the rank of their merge and the id it makes."""

    def __init__(self, byte_ids: Sequence[int], pairs: Mapping[tuple[int, int], tuple[int, int]]) -> None:
        self.byte_ids = np.array(byte_ids, np.int64)
        keys = np.array([a << 20 | b for a, b in pairs], np.int64).reshape(-1)
        made = np.array(list(pairs.values()), np.int64).reshape(-1, 2)
        self.pairs = Numbers(keys, made[:, 0] << 20 | made[:, 1])

    def merge(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per piece a row of ids, padded with -1, and their number. Pieces may have up to ``SHORT`` bytes."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = max(2, int(sizes.max(initial=0)))
        ids = np.full((len(pieces), width), -1, np.int64)
        inside = np.arange(width) < sizes[:, None]
        ids[inside] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        open_ = np.arange(len(pieces))
        columns = np.arange(width)
        while open_.size:
            row_ids, row_ranks = ids[open_], ranks[open_]
            at = row_ranks.argmin(axis=1)
            rows = np.arange(len(open_))
            low = row_ranks[rows, at]
            go = low < NEVER
            open_, at, low, row_ids, row_ranks = open_[go], at[go], low[go], row_ids[go], row_ranks[go]
            if not open_.size:
                break
            rows = np.arange(len(open_))
            row_ids[rows, at] = low & 0xFFFFF
            behind = columns[:-1] + (columns[:-1] > at[:, None])
            row_ids[:, :-1] = np.take_along_axis(row_ids, behind, 1)
            row_ids[:, -1] = -1
            if width > 2:
                behind = columns[:-2] + (columns[:-2] >= at[:, None])
                row_ranks[:, :-1] = np.take_along_axis(row_ranks, np.minimum(behind, width - 2), 1)
            row_ranks[:, -1] = NEVER
            right = np.minimum(at, width - 2)
            row_ranks[rows, right] = self._ranks(row_ids[rows, right], row_ids[rows, right + 1])
            left = np.maximum(at - 1, 0)
            row_ranks[rows, left] = self._ranks(row_ids[rows, left], row_ids[rows, left + 1])
            ids[open_], ranks[open_] = row_ids, row_ranks
        return ids, (ids >= 0).sum(axis=1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank and made id in one number, so that the lowest rank is the lowest number; ``NEVER`` for no merge."""
        found = self.pairs.get(np.where(b >= 0, a << 20 | (b & 0xFFFFF), -2).reshape(-1), NEVER)
        return found.reshape(a.shape)
