"""Vectorised words of many texts at once: positions, owners and 64-bit hashes of runs of word bytes."""

from __future__ import annotations

import functools
from typing import NamedTuple

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Words(NamedTuple):
    owner: np.ndarray  # index of the text
    start: np.ndarray  # first byte in the joined texts
    end: np.ndarray
    hash: np.ndarray  # never zero


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    values = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
    powers = np.cumprod(np.full(1 << 16, np.uint64(0xD1342543DE82EF95)))
    return values, powers


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ x >> np.uint64(30)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bytes(kind: str) -> np.ndarray:
    """Which bytes belong to words: "alnum" has digits, letters and all of non-ASCII; "black" all but white space."""
    table = np.zeros(256, bool)
    if kind == "alnum":
        table[48:58] = table[97:123] = table[128:] = True
    else:
        table[:] = True
        table[9:14] = table[32] = False
    return table


def words(texts: list[bytes], table: np.ndarray) -> Words:
    """Words of all texts, A-Z lower-cased. Equal words have equal hashes."""
    joined = b"\n".join(texts).translate(_LOWER)
    raw = np.frombuffer(joined, np.uint8)
    inside = table[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64))
    values, powers = _tables()
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(first[-1] + length[-1])) - np.repeat(first, length)
    if length.max() > len(powers):
        powers = np.cumprod(np.full(int(length.max()), powers[0]))
    code = np.add.reduceat(values[raw[inside]] * powers[place], first)
    code = mix(code ^ length.astype(np.uint64) * MULTIPLIER)
    code[code == 0] = 1
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return Words(np.searchsorted(bounds, start, "right"), start, end, code)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether they lie in one text."""
    if len(w.hash) < n:
        return np.empty(0, np.uint64), np.empty(0, bool)
    size = len(w.hash) - n + 1
    code = w.hash[:size].copy()
    for k in range(1, n):
        code = mix(code * MULTIPLIER + w.hash[k : k + size])
    return code, w.owner[:size] == w.owner[n - 1 :]
