"""Texts cut into matches of a split pattern, remembering the cuts between blanks."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex

from tracelake.llm.merging import REMEMBERED, REMEMBERED_CHARS, Remembered

# The pattern that splits texts for the public byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Unsettled(Exception):
    """A cut that stands at white space the pattern may join to what is before it."""


def cuts(text: str) -> list[str]:
    """The text cut before every blank. Exact unless a cut is a blank before white space, see ``checked``."""
    return text.replace(" ", "\0 ").split("\0")


def checked(cut: str) -> str:
    if cut[:1] == " " and (len(cut) == 1 or cut[1].isspace()):
        raise Unsettled
    return cut


def adapted_pattern(pattern: str, letters_and_numbers: Callable[[str], set[str]]) -> str:
    r"""``pattern`` with the classes \p{L} and \p{N} as another library has them, whose Unicode version may differ.

    ``letters_and_numbers(name)`` gives all characters that the library counts to the class.
    """
    for name in (r"\p{L}", r"\p{N}"):
        mine, theirs = set(regex.findall(name, every_character())), letters_and_numbers(name)
        less, more = ranges(mine - theirs), ranges(theirs - mine)
        if less or more:
            pattern = pattern.replace(name, f"[{name}{more}" + (f"--[{less}]]" if less else "]"))
    return pattern


@lru_cache(1)
def every_character() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def ranges(characters: set[str]) -> str:
    """The characters as ranges of a character class."""
    out: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Scanner:
    """Values of the matches of ``pattern``, and of cuts made of whole matches.

    The text before a blank that is followed by another character than white space never reaches over that blank. So
    texts are cut there, and the pattern only runs on cuts that this worker has not seen yet. ``find`` works out the
    values of new matches, ``fold`` makes the value of a cut of those of its matches.
    """

    def __init__(
        self, pattern: str, find: Callable[[list[str]], list], fold: Callable, remembered: int = REMEMBERED
    ) -> None:
        self.pattern = regex.compile(pattern, flags=regex.V1)
        self.find, self.fold = find, fold
        self.pieces = Remembered(lambda piece: find([piece])[0], remembered)
        self.cuts = Remembered(lambda cut: self.scanned(checked(cut)), 3 * remembered // 2)

    def scanned(self, text: str):
        return self.fold(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def learn(self, found: set[str]) -> None:
        """Work out new cuts in one scan: a cut that starts with a blank starts a match wherever it stands."""
        new = [
            c for c in self.cuts.unseen(found) if c[:1] == " " and 1 < len(c) <= REMEMBERED_CHARS and not c[1].isspace()
        ]
        pieces = self.pattern.findall("".join(new))
        unseen = list(self.pieces.unseen(pieces))
        for piece, value in zip(unseen, self.find(unseen)):
            self.pieces.keep(piece, value)
        values = list(map(self.pieces.__getitem__, pieces))
        ends = np.fromiter(accumulate(map(len, pieces)), np.int64, len(pieces))
        stops = np.searchsorted(ends, np.fromiter(accumulate(map(len, new)), np.int64, len(new))) + 1
        start = 0
        for cut, stop in zip(new, stops.tolist()):
            self.cuts.keep(cut, self.fold(values[start:stop]))
            start = stop

    def units(self, text: str, units: list[str] | None = None) -> tuple[list[str], list]:
        """The text in cuts, or in matches where cuts will not do, and their values as ``fold`` takes or gives them."""
        units = units or (cuts(text) if "\0" not in text else None)
        if units:
            try:
                return units, list(map(self.cuts.__getitem__, units))
            except Unsettled:
                pass
        units = self.pattern.findall(text)
        return units, [self.fold((v,)) for v in map(self.pieces.__getitem__, units)]
