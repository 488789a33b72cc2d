"""Token counts at every prefix, by dynamic programming over the prefixes.

The encoding of a prefix is the encoding of a shorter prefix and one more token: the one that ends there, is its own
encoding, and goes with the last token of the shorter prefix. So one pass keeps, for every prefix, its last token and
its count, and any later question about truncation or a budget is a look at the counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tracelake.llm.merging import SHORT, ManyMerger, Merger, Numbers
from tracelake.llm.scanning import PATTERN, Scanner, adapted_pattern, cuts, every_character
from tracelake.llm.shared import slices

PAIRS_KEPT = 1 << 20
# So few pairs are merged one by one.
FEW = 8
HASH_STEP = np.uint64(0x100000001B3)
LOW_BITS = np.uint64(0x7FFFFFFFFFFFFFFF)


def tokenizers_pattern(pattern: str = PATTERN) -> str:
    """The pattern with the character classes of the installed tokenizers library."""
    from tokenizers import Regex, pre_tokenizers

    def members(name: str) -> set[str]:
        found = pre_tokenizers.Split(Regex(f"{name}+"), "removed", invert=True)
        return set("".join(x for x, _ in found.pre_tokenize_str(every_character())))

    return adapted_pattern(pattern, members)


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


class PrefixCounter:
    """Counts by the vocabulary and merges of a byte-level tokenizers file."""

    def __init__(self, tokenizer_path: str, pattern: str) -> None:
        with open(tokenizer_path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        letters = byte_letters()
        # Added tokens stand in the vocabulary too, but no merge makes them.
        added = {t["content"] for t in spec["added_tokens"]}
        self.ids = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merges = [(bytes(letters[c] for c in a), bytes(letters[c] for c in b)) for a, b in merges]
        ranks = {m: rank for rank, m in reversed(list(enumerate(merges)))}
        self.merger = Merger(lambda a, b: ranks.get((a, b)))
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.many = ManyMerger([self.ids[bytes([b])] for b in range(256)], pairs)
        self.token = {i: t for t, i in self.ids.items()}
        self.together: dict[int, bool] = {}
        # Tokens that are their own encoding, by a hash of their bytes.
        whole = [t for t in self.ids if len(t) > SHORT and self.merger.merge(t) == [t]]
        short = [t for t in self.ids if len(t) <= SHORT]
        _, sizes = self.many.merge(short)
        self.whole = whole + [t for t, n in zip(short, sizes.tolist()) if n == 1]
        self.longest = max(map(len, self.whole))
        keys = np.array([self._hash(t) for t in self.whole], np.uint64).astype(np.int64)
        if len(set(keys.tolist())) != len(keys):
            raise ValueError("two tokens have one hash")
        self.by_hash = Numbers(keys, np.array([self.ids[t] for t in self.whole], np.int64))
        self.whole_ids = {t: self.ids[t] for t in self.whole}
        self.scanner = Scanner(pattern, self._pieces, sum_of_last)

    @staticmethod
    def _check(spec: dict) -> None:
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        added = spec.get("added_tokens") or []
        if not plain or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            raise ValueError("a byte-level BPE tokenizer without normalizer and prefix space is needed")
        if any(t.get("single_word") or t.get("lstrip") or t.get("rstrip") for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")

    @staticmethod
    def _hash(data: bytes) -> int:
        value = 0
        for b in data:
            value = (value * int(HASH_STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return value & 0x7FFFFFFFFFFFFFFF

    def _go_together(self, codes: np.ndarray) -> np.ndarray:
        """Whether two tokens, merged on their own, stay the two; worked out once for each pair."""
        if len(self.together) > PAIRS_KEPT:
            self.together.clear()
        known, asked = self.together, codes.tolist()
        new = set(asked).difference(known)
        short, kept = [], []
        for c in new:
            a, b = self.token[c >> 20], self.token[c & 0xFFFFF]
            if len(a) + len(b) <= SHORT and len(new) > FEW:
                short.append(a + b)
                kept.append(c)
            else:
                known[c] = self.merger.merge(a + b) == [a, b]
        if short:
            rows, sizes = self.many.merge(short)
            same = (sizes == 2) & ((rows[:, 0] << 20 | rows[:, 1]) == np.array(kept, np.int64))
            known.update(zip(kept, same.tolist()))
        return np.fromiter(map(known.__getitem__, asked), bool, len(asked))

    def count_prefixes(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Per piece the counts of its prefixes of 1, 2, ... bytes."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            at = [n for n, p in enumerate(pieces) if low < len(p) <= high]
            if at:
                counts = self._many_prefixes([pieces[n] for n in at])
                for row, n in enumerate(at):
                    out[n] = counts[row, 1 : len(pieces[n]) + 1]
        return [self._long_prefixes(p) if c is None else c for p, c in zip(pieces, out)]

    def _many_prefixes(self, pieces: list[bytes]) -> np.ndarray:
        rows, width = len(pieces), max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        data = np.zeros((rows, width), np.uint64)
        data[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        # ends[end] lists (start, ids of the bytes from start to end).
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(width + 1)]
        value = np.zeros((rows, width), np.uint64)
        for size in range(1, min(width, self.longest) + 1):
            value = value[:, : width - size + 1] * HASH_STEP + data[:, size - 1 :] + np.uint64(1)
            ids = self.by_hash.get((value & LOW_BITS).astype(np.int64).reshape(-1), -1).reshape(value.shape)
            for start in range(width - size + 1):
                ends[start + size].append((start, ids[:, start]))
        for found in ends:
            found.reverse()
        last = np.full((rows, width + 1), -1, np.int64)
        counts = np.zeros((rows, width + 1), np.int32)
        for end in range(1, width + 1):
            open_ = np.flatnonzero(sizes >= end)
            # The longest token that ends here is the right one most often.
            for start, ids in ends[end]:
                rows_here = open_[ids[open_] >= 0]
                if not rows_here.size:
                    continue
                token = ids[rows_here]
                if start:
                    right = self._go_together(last[rows_here, start] << 20 | token)
                    rows_here, token = rows_here[right], token[right]
                last[rows_here, end] = token
                counts[rows_here, end] = counts[rows_here, start] + 1
                open_ = open_[last[open_, end] < 0]
                if not open_.size:
                    break
        return counts

    def _long_prefixes(self, data: bytes) -> np.ndarray:
        counts, last = np.zeros(len(data) + 1, np.int32), [-1] * (len(data) + 1)
        get, together = self.whole_ids.get, self.together
        for end in range(1, len(data) + 1):
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                token = get(data[start:end])
                if token is None:
                    continue
                code = last[start] << 20 | token
                if start and code not in together:
                    self._go_together(np.array([code]))
                if not start or together[code]:
                    last[end], counts[end] = token, counts[start] + 1
                    break
        return counts[1:]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """The counts of the prefixes of matches, by characters, as 32-bit numbers."""
        data = [p.encode() for p in pieces]
        out = []
        for piece, raw, counts in zip(pieces, data, self.count_prefixes(data)):
            if len(raw) != len(piece):
                counts = counts[np.cumsum([len(c.encode()) for c in piece]) - 1]
            if piece[0] == "'" and len(piece) > 2 and piece[1].isalpha():
                # A contraction cut short is two matches.
                counts = counts.copy()
                for n in range(1, len(piece) - 1):
                    counts[n] = self.total(piece[0]) + self.total(piece[1 : n + 1])
            out.append(counts.astype("<i4").tobytes())
        return out

    def total(self, text: str) -> int:
        return self.scanner.scanned(text)

    def prefixes(self, text: str) -> np.ndarray:
        """The counts of the prefixes of 1, 2, ... characters of a text without special strings."""
        out, base, before, base_before, at = np.zeros(len(text), np.int32), 0, "", 0, 0
        for piece in self.scanner.pattern.findall(text):
            counts = np.frombuffer(self.scanner.pieces[piece], "<i4")
            out[at : at + len(piece)] = base + counts
            if piece[0].isspace() and before[-1:].isspace() and before.strip() == "":
                # Cut here, the white space before it and this character are one match.
                out[at] = base_before + self.total(before + piece[0])
            base_before, before, at = base, piece, at + len(piece)
            base += int(counts[-1])
        return out

    def parts(self, text: str) -> list[tuple[str, int]]:
        """The text without its special strings, and how many tokens each of the strings between is: one."""
        parts = [text]
        for special in self.special:
            parts = [x for p in parts for x in ((p,) if p in self.special else _between(p, special))]
        return [(p, int(p in self.special)) for p in parts if p]

    def all_prefixes(self, text: str) -> np.ndarray:
        """The counts of the prefixes of 1, 2, ... characters of any text."""
        out, base, before = [], 0, ""
        for part, special in self.parts(text):
            if special:
                # Up to its last character a special string is ordinary text that goes on from the part before.
                begun = self.prefixes(before + part[:-1])[len(before) :]
                base_before = base - (self.total(before) if before else 0)
                out += [base_before + begun, np.array([base + 1], np.int32)]
                base, before = base + 1, ""
            else:
                counts = self.prefixes(part)
                out.append(base + counts)
                base, before = base + int(counts[-1]), part
        return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)

    def count(self, text: str, limit: int, units: list[str] | None = None) -> tuple[int, int]:
        """Tokens of the whole text, and the characters of its longest prefix that has at most ``limit`` tokens."""
        if any(s in text for s in self.special):
            counts = self.all_prefixes(text)
            fits = np.flatnonzero(counts <= limit)
            return int(counts[-1]), int(fits[-1]) + 1 if len(fits) else 0
        units, totals = self.scanner.units(text, units)
        ends = np.cumsum(totals) if totals else np.zeros(1, np.int64)
        if ends[-1] <= limit:
            return int(ends[-1]), len(text)
        # The longest prefix ends in the last unit before which fewer tokens than the limit stand. The unit before it
        # is looked at with it, as white space may reach over their seam.
        n = int(np.searchsorted(ends, limit, "left"))
        first = max(0, n - 1)
        start, base = sum(map(len, units[:first])), int(ends[first - 1]) if first else 0
        counts = base + self.prefixes("".join(units[first : n + 2]))
        stop = sum(map(len, units[first : n + 1]))
        fits = np.flatnonzero(counts[: stop + 1] <= limit)
        return int(ends[-1]), start + int(fits[-1]) + 1 if len(fits) else start

    def count_many(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        units = [cuts(text) if "\0" not in text else [] for text in texts]
        self.scanner.learn(set().union(*units))
        return [self.count(text, limit, parts) for text, parts in zip(texts, units)]


def sum_of_last(values) -> int:
    """The tokens of matches: the count of the last prefix of each."""
    return sum(int.from_bytes(v[-4:], "little") for v in values)


def _between(text: str, special: str) -> list[str]:
    parts = text.split(special)
    return [x for p in parts[:-1] for x in (p, special)] + parts[-1:]


@lru_cache(2)
def prefix_counter(tokenizer_path: str, pattern: str) -> PrefixCounter:
    """One counter per worker, so that tasks that follow know the words of those before."""
    return PrefixCounter(tokenizer_path, pattern)


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int,
    text: str = "text",
    prefixes: bool = False,
    pattern: str | None = None,
) -> DataFrame:
    """Add ``n_tokens`` of the whole ``text`` and ``fitting_chars``, the characters of its longest prefix that has at
    most ``limit`` tokens. With ``prefixes``, ``prefix_counts`` lists the tokens of every prefix, by characters.

    A null text counts as empty: no tokens. Columns with these names are replaced, all others are kept, and rows keep
    their partition. Special strings inside texts count as their one token.
    """
    pattern = tokenizers_pattern() if pattern is None else pattern
    added = [("n_tokens", T.LongType()), ("fitting_chars", T.LongType())]
    if prefixes:
        added.append(("prefix_counts", T.ArrayType(T.IntegerType(), False)))
    kept = [f for f in docs.schema.fields if f.name not in dict(added)]
    schema = T.StructType([*kept, *(T.StructField(n, kind) for n, kind in added)])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(tokenizer_path, pattern)
        for part in slices(batches):
            texts = [x or "" for x in part.column(text).to_pylist()]
            counted = counter.count_many(texts, limit)
            columns = [pa.array([c[n] for c in counted], pa.int64()) for n in (0, 1)]
            if prefixes:
                columns.append(pa.array([counter.all_prefixes(t) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns], schema.names)

    return docs.mapInArrow(run, schema)


def within_budget(counted: DataFrame, budget: int, out: str = "budget_chars") -> DataFrame:
    """Add the characters of the longest prefix with at most ``budget`` tokens, from ``prefix_counts`` alone."""
    from pyspark.sql import functions as F

    fits = F.transform("prefix_counts", lambda c, i: F.when(c <= budget, i + 1))
    return counted.withColumn(out, F.coalesce(F.array_max(fits), F.lit(0)).cast("long"))
