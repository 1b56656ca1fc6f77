"""Vectorised 64-bit hashes of words and word windows over the bytes of many texts at once.

Words are maximal runs without space, tab, LF, VT, FF, CR; A-Z count as a-z unless asked otherwise. A word's hash is a
polynomial over its bytes modulo 2**64 taken from prefix sums, then mixed, so no word becomes a
Python object. Texts are hashed in pieces of at most ``PIECE`` bytes that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_WINDOW_KEYS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (64-bit shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Holds the powers of the base and of its inverse for pieces of a given size."""

    def __init__(self, size: int = PIECE, lower: bool = True):
        self.bytes = _LOWER if lower else np.arange(256, dtype=np.uint8)
        self._grow(size)

    def _grow(self, size: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        self.size = size
        self.powers = np.cumprod(np.full(size, _BASE, dtype=np.uint64), dtype=np.uint64)
        self.inverse = np.cumprod(np.full(size, inverse, dtype=np.uint64), dtype=np.uint64)

    def words(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and start byte of every word in a piece."""
        if len(piece) > self.size:
            self._grow(len(piece))
        inside = np.zeros(len(piece) + 2, dtype=np.int8)
        inside[1:-1] = ~_SPACE[piece]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if not len(starts):
            return np.empty(0, dtype=np.uint64), starts
        values = self.bytes[piece].astype(np.uint64)
        values += np.uint64(1)
        values *= self.powers[: len(piece)]
        total = np.zeros(len(piece) + 1, dtype=np.uint64)
        np.cumsum(values, out=total[1:])
        hashes = (total[ends] - total[starts]) * self.inverse[starts]
        return mix(hashes ^ ((ends - starts).astype(np.uint64) * np.uint64(_BASE))), starts

    def texts(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """(position, word hashes) of every text; short texts are hashed together."""
        waiting, size = [], 0
        for i, text in enumerate(texts):
            if size and size + len(text) > PIECE:
                yield from self._together(waiting, texts)
                waiting, size = [], 0
            if len(text) > PIECE:
                yield i, self._long(text)
            else:
                waiting.append(i)
                size += len(text) + 1
        if waiting:
            yield from self._together(waiting, texts)

    def _together(self, waiting: list[int], texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        hashes, starts = self.words(np.frombuffer(b" ".join([texts[i] for i in waiting]), dtype=np.uint8))
        borders = np.cumsum([len(texts[i]) + 1 for i in waiting])
        cuts = np.searchsorted(starts, borders)
        low = 0
        for i, high in zip(waiting, cuts):
            yield i, hashes[low:high]
            low = high

    def _long(self, text: bytes) -> np.ndarray:
        """A text of any length, piece by piece; a piece ends before white space, or grows up to it."""
        data, low, parts = np.frombuffer(text, dtype=np.uint8), 0, []
        while low < len(data):
            high = low + PIECE
            while high < len(data) and not _SPACE[data[high]]:
                blank = np.flatnonzero(_SPACE[data[high : high + 65536]])
                high = high + (int(blank[0]) if len(blank) else min(65536, len(data) - high))
            parts.append(self.words(data[low:high])[0])
            low = high
        return np.concatenate(parts)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word windows; one hash of the whole sequence below ``width`` words."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    if n < width:
        x = np.uint64(n)
        for w in words:
            x = mix(np.array([x ^ w], dtype=np.uint64))[0] + np.uint64(n)
        return np.array([x], dtype=np.uint64)
    x = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        key = mix(np.array([j], dtype=np.uint64))[0] | np.uint64(1) if j >= len(_WINDOW_KEYS) else _WINDOW_KEYS[j]
        x += words[j : n - width + 1 + j] * key
    return np.unique(mix(x))
