"""Encoding texts by their units: each distinct unit is encoded once per worker, then gathered for every occurrence.

A text is cut before spaces that follow another character than white space. Both tokenisers used here never join
the two sides of such a cut, so a text's ids are its units' ids in a row.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Hashable, Sequence
from itertools import repeat

import numpy as np

UNITS_KEPT = 400_000  # of a worker; beyond so many the units are encoded anew, with the same result

# Every white space that can stand before a space; other texts are cut at their spaces without a search by pattern.
_SPACES = [c for c in map(chr, range(0x110000)) if c.isspace()]
_ASCII_SPACES = [(c, c + " ") for c in _SPACES if c.isascii()]
_OTHER_SPACES = re.compile("[" + "".join(c for c in _SPACES if not c.isascii()) + "] ")
_CUT = re.compile(r"(?<=\S)(?= )")


def cut(text: str) -> list[Hashable]:
    """The text's units: a one-tuple for the first, then each without the one space it starts with."""
    if text[:1] != " " and not any(c in text and pair in text for c, pair in _ASCII_SPACES) and (
        text.isascii() or not _OTHER_SPACES.search(text)
    ):
        parts: list[Hashable] = text.split(" ")  # type: ignore[assignment]
    else:
        first, *rest = _CUT.split(text)
        parts = [first, *(p[1:] for p in rest)]
    parts[0] = (parts[0],)
    return parts


class UnitEncoder:
    """``encode_new`` gives, for a list of units, their ids in a row and the number of ids of each."""

    def __init__(self, encode_new: Callable[[Sequence[Hashable]], tuple[np.ndarray, np.ndarray]], dtype: type, kept: int = UNITS_KEPT):
        self._encode_new, self._dtype, self._kept = encode_new, dtype, kept
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[Hashable, int] = {}
        self._ids = np.empty(0, self._dtype)
        self._starts, self._sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the number of ids per text; an empty text has none."""
        units: list[Hashable] = []
        per_text = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                parts = cut(text)
                units += parts
                per_text[i] = len(parts)
        ids, sizes = self.units(units)
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(per_text)))]
        return ids, np.diff(bounds)

    def units(self, units: Sequence[Hashable]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and the number of ids per unit."""
        if len(self._numbers) > self._kept:
            self._forget()
        numbers = np.fromiter(map(self._numbers.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(numbers < 0).tolist()
        if missing:
            absent = [units[i] for i in missing]
            new = list(dict.fromkeys(absent))
            gc.disable()  # hundreds of thousands of short lists, none of them in a cycle
            try:
                ids, sizes = self._encode_new(new)
            finally:
                gc.enable()
            starts = np.cumsum(sizes) - sizes + len(self._ids)
            self._numbers.update(zip(new, range(len(self._numbers), len(self._numbers) + len(new))))
            self._ids = np.concatenate((self._ids, ids.astype(self._dtype)))
            self._starts = np.concatenate((self._starts, starts))
            self._sizes = np.concatenate((self._sizes, sizes))
            numbers[missing] = np.fromiter(map(self._numbers.get, absent), np.int64, len(absent))
        sizes = self._sizes[numbers]
        return gather(self._ids, self._starts[numbers], sizes), sizes


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """``values[s:s + n]`` of every start and size in a row."""
    ends = np.cumsum(sizes) if ends is None else ends
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]
