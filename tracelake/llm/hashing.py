"""Hashed subwords of many tokens at once, and rows remembered per token."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
TOKENS_KEPT = 200_000
# Tokens whose buckets are worked out at a time.
TOKENS_HASHED = 1 << 13
STEP, SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def runs_of_letters(token: str) -> list[str]:
    """The runs of letters. The pattern also takes numerals that are no digits, such as fractions; they end a run."""
    out = []
    for word in LETTERS.findall(token):
        out += [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split(" ")
    return [word for word in out if word]


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _marked_words(tokens: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all tokens between their marks, as code points plus one; their sizes, and the numbers of their tokens.

    Words are those of ``runs_of_letters``, found in all tokens at once.
    """
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), "<u4")
    of_token = np.repeat(np.arange(len(tokens)), np.fromiter(map(len, tokens), np.int64, len(tokens)))
    letters = np.flatnonzero(_letters()[codes])
    # A word starts behind a gap, or where the next token does.
    follows = (np.diff(letters, prepend=-2) == 1) & (np.diff(of_token[letters], prepend=-1) == 0)
    starts = np.flatnonzero(~follows)
    owner, sizes = of_token[letters[starts]], np.diff([*starts, len(letters)]) + 2
    ends = np.cumsum(sizes)
    marked = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    inside = np.ones(len(marked), bool)
    for at, mark in ((ends - sizes, "<"), (ends - 1, ">")):
        marked[at], inside[at] = ord(mark), False
    marked[inside] = codes[letters]
    return marked + np.uint64(1), sizes, owner


class Subwords:
    """The buckets of tokens between white space, as flat numbers: token ``i`` has ``flat[starts[i]:starts[i + 1]]``.

    A token's words are its runs of letters, each with marks at both ends. A word has itself, its character n-grams of
    the sizes ``grams`` and its beginnings of the sizes ``beginnings`` (marks count). Tokens without letters have none.
    """

    def __init__(self, tokens: Sequence[str], bits: int, grams: Sequence[int] = (), beginnings: Sequence[int] = ()) -> None:
        # Some tokens at a time, as working them out takes many times the room of what is kept.
        parts = [
            self._buckets(tokens[start : start + TOKENS_HASHED], bits, grams, beginnings)
            for start in range(0, max(1, len(tokens)), TOKENS_HASHED)
        ]
        self.flat = np.concatenate([flat for flat, _ in parts])
        self.sizes = np.concatenate([sizes for _, sizes in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def _buckets(self, tokens: Sequence[str], bits: int, grams: Sequence[int], beginnings: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        codes, sizes, owner = _marked_words(tokens)
        first = np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        # The polynomial hash of the first n characters of a word, from the powers of one walk over all texts.
        found_owner, found = [], []

        def add(at: np.ndarray, hashes: np.ndarray, salt: int) -> None:
            mixed = (hashes + np.uint64(salt)) * SPREAD
            mixed = (mixed ^ (mixed >> np.uint64(29))) * SPREAD
            found_owner.append(owner[at])
            found.append((mixed >> np.uint64(64 - bits)).astype(np.int64))

        if len(sizes):
            longest = int(max([*grams, *beginnings, 1]))
            value = np.zeros(len(codes), np.uint64)
            for n in range(1, longest + 1):
                # value[i]: hash of the n characters from i.
                value = value[: len(codes) - n + 1] * STEP + codes[n - 1 :]
                if n in grams:
                    at = np.flatnonzero(word[: len(value)] == word[n - 1 :])
                    add(word[at], value[at], n)
                if n in beginnings:
                    at = np.flatnonzero(sizes >= n)
                    add(at, value[first[at]], 64 + n)
            whole = np.add.reduceat(codes * (SPREAD + STEP * (np.arange(len(codes)) - first[word]).astype(np.uint64) ** 3), first)
            add(np.arange(len(sizes)), whole, 128)
        owners_of_all = np.concatenate(found_owner) if found else np.zeros(0, np.int64)
        order = np.argsort(owners_of_all, kind="stable")
        flat = np.concatenate(found)[order] if found else np.zeros(0, np.int64)
        return flat.astype(np.int32), np.bincount(owners_of_all, minlength=len(tokens))

    def pick(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the tokens with these numbers, and how many each has."""
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[tokens] - (ends - sizes), sizes)
        return self.flat[at], sizes


def row_sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``sizes`` rows each, one after the other; no rows sum to zeros."""
    out = np.zeros((len(sizes), rows.shape[1]), rows.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


class TokenRows:
    """A numpy row per token. Unknown tokens are worked out together; emptied when full, between slices of texts."""

    def __init__(self, width: int, find: Callable[[list[str]], np.ndarray], most: int = TOKENS_KEPT) -> None:
        self.find, self.most = find, most
        self.rows = np.zeros((1024, width), np.float32)
        self.index: dict[str, int] = {}

    def learn(self, tokens: set[str]) -> None:
        if len(self.index) > self.most:
            self.index.clear()
        new = list(tokens.difference(self.index))
        start = len(self.index)
        while start + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for at in range(0, len(new), TOKENS_HASHED):
            part = new[at : at + TOKENS_HASHED]
            self.rows[start + at : start + at + len(part)] = self.find(part)
        self.index.update(zip(new, range(start, start + len(new))))

    def of(self, tokens: list[str]) -> np.ndarray:
        """The rows of learnt tokens, in order."""
        return self.rows[np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))]
