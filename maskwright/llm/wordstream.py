"""Words, rolling hashes and window minima over UTF-8 text held in Arrow buffers.

Everything here works on one bounded block of bytes at a time (see ``blocks``) with numpy, inside Spark tasks.
A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those bytes never occur inside a multi-byte
UTF-8 character, so byte work and code point work agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For matching that ignores punctuation: all ASCII characters but letters and digits stand between words.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:128] = [not chr(i).isalnum() for i in range(128)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

# Odd multipliers of two unrelated polynomial hashes, by level (bytes of a word, words of a window).
_BASES = {
    "byte": 0x9E3779B97F4A7C15, "word": 0xC2B2AE3D27D4EB4F, "byte2": 0xD6E8FEB86659FD93, "word2": 0xA0761D6478BD642F
}
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(level: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the level's base and of its inverse modulo 2**64, at least n of each."""
    have = _POWERS.get(level)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        both = []
        for base in (_BASES[level], pow(_BASES[level], -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 4 * BLOCK_BYTES:
            _POWERS[level] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them; null counts as empty."""
    if col.null_count:
        col = pc.fill_null(col, "")
    width = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[
        col.offset : col.offset + len(col) + 1
    ].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def blocks(off: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have up to ``limit`` bytes together; a longer text stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[data]


class Words:
    """The words of the texts of one block: byte ranges, and for each text its range of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, between: np.ndarray = _SPACE):
        self.data = data = data[off[0] : off[-1]]
        off = off - off[0]
        solid = ~between[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[off] = True
        before = np.empty(len(data), bool)
        if len(data):
            before[0] = True
            np.logical_not(solid[:-1], out=before[1:])
        before |= cut[:-1]
        self.start = np.flatnonzero(solid & before)
        after = np.empty(len(data), bool)
        if len(data):
            after[-1] = True
            np.logical_not(solid[1:], out=after[:-1])
        after |= cut[1:]
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, off[:-1])
        self.last = np.append(self.first[1:], len(self.start))

    def hashes(self, level: str = "byte") -> np.ndarray:
        """A 64-bit hash of each word."""
        n = len(self.data)
        up, down = _powers(level, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])


def grams(words: np.ndarray, k: int, level: str = "word") -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(level, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of each ``width`` consecutive ones, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def joined_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of a block with one space between neighbours, and where each word starts and ends there."""
    sizes = words.end - words.start
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    ends = starts + sizes
    edge = np.zeros(len(words.data) + 1, np.int8)
    edge[words.start] += 1
    edge[words.end] -= 1
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    room = np.ones(len(out), bool)
    room[ends] = False
    out[room] = words.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return out, starts, ends
