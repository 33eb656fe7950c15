"""Hashes of the words of a text and of runs of them, computed on whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Texts are hashed together up to about so many characters; a longer one is hashed by itself.
CHUNK_CHARS = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 0xD6E8FEB86659FD93


def word_table() -> np.ndarray:
    """Whether each code point is part of a word: letters, digits and the low line."""
    return np.fromiter((chr(c).isalnum() or c == 0x5F for c in range(0x110000)), bool, 0x110000)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words:
    """Hashes words of lower-cased texts by a rolling polynomial; keeps its tables between texts."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.grow(1 << 14)

    def grow(self, size: int) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(size + 1, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.up, self.down = powers(_BASE), powers(_INVERSE)

    def spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Running sums of the polynomial, and where each word starts and ends."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
        if len(codes) >= len(self.up):
            self.grow(2 * len(codes))
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = np.take(self.table, codes)
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[: len(codes)], out=sums[1:])
        return sums, edges[::2], edges[1::2]

    def between(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each stretch of characters; equal stretches have equal hashes wherever they are."""
        return mixed((sums[ends] - sums[starts]) * self.down[starts])

    def hashes(self, text: str | None) -> np.ndarray:
        return self.between(*self.spans(text))

    def hashes_of(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``hashes`` of many texts, some at a time: those of some texts in a row, and where each text's end."""
        held, size = [], 0
        for text in texts:
            lowered = (text or "").lower()
            if held and size + len(lowered) > CHUNK_CHARS:
                yield self._together(held)
                held, size = [], 0
            held.append(lowered)
            size += len(lowered) + 1
        if held:
            yield self._together(held)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A line feed, no part of a word, parts the texts.
        sums, starts, ends = self.spans("\n".join(texts))
        return self.between(sums, starts, ends), np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each run of ``n`` neighbours; fewer than ``n`` make one run, none make none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total = total * np.uint64(_STEP) + hashes[k : k + size]
    return mixed(total + np.uint64(n))
