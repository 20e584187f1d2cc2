"""Compressed sets of 16-bit codes: a sorted list while few, a bit field once that is smaller."""

from __future__ import annotations

import numpy as np

SPAN = 1 << 16
DENSE = 4096  # from this many codes on, 8 KB of bits are smaller than two bytes a code


class CodeSet:
    """The codes of one span of SPAN codes."""

    __slots__ = ("bits", "few")

    def __init__(self, codes: np.ndarray):
        """codes: integers of [0, SPAN), in any order, with repeats."""
        marks = np.zeros(SPAN, np.bool_)
        marks[codes] = True
        self._hold(marks)

    def _hold(self, marks: np.ndarray) -> None:
        if np.count_nonzero(marks) >= DENSE:
            self.bits, self.few = np.packbits(marks, bitorder="little"), None
        else:
            self.bits, self.few = None, np.flatnonzero(marks).astype(np.uint16)

    def codes(self) -> np.ndarray:
        if self.few is not None:
            return self.few.astype(np.int64)
        return np.flatnonzero(np.unpackbits(self.bits, bitorder="little"))

    def and_not(self, other: CodeSet) -> CodeSet:
        out = object.__new__(CodeSet)
        if self.bits is not None and other.bits is not None:
            out._hold(np.unpackbits(self.bits & ~other.bits, bitorder="little").view(np.bool_))
        elif self.few is not None:
            there = other._holds(self.few)
            out.bits, out.few = None, self.few[~there]
        else:
            marks = np.unpackbits(self.bits, bitorder="little").view(np.bool_)
            marks[other.few] = False
            out._hold(marks)
        return out

    def _holds(self, codes: np.ndarray) -> np.ndarray:
        if self.few is not None:
            return np.isin(codes, self.few, assume_unique=True)
        return (self.bits[codes >> 3] >> (codes & 7).astype(np.uint8)) & 1 == 1

    def __len__(self) -> int:
        return len(self.few) if self.few is not None else int(np.bitwise_count(self.bits).sum())


class Bitmap:
    """A set of non-negative integers, span by span."""

    def __init__(self, values: np.ndarray | None = None):
        self.spans: dict[int, CodeSet] = {}
        if values is not None and len(values):
            values = np.sort(np.asarray(values, np.int64))
            high = values >> 16
            cuts = np.flatnonzero(np.diff(high)) + 1
            for part in np.split(values, cuts):
                self.spans[int(part[0] >> 16)] = CodeSet((part & (SPAN - 1)).astype(np.int64))

    def and_not(self, other: Bitmap) -> Bitmap:
        out = Bitmap()
        for high, mine in self.spans.items():
            left = mine.and_not(other.spans[high]) if high in other.spans else mine
            if len(left):
                out.spans[high] = left
        return out

    def values(self) -> np.ndarray:
        parts = [(high << 16) + self.spans[high].codes() for high in sorted(self.spans)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return sum(map(len, self.spans.values()))
