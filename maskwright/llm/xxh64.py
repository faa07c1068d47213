"""XXH64 of many slices of one byte buffer at once, in numpy (the public XXH64 specification)."""

from __future__ import annotations

import numpy as np

# The five primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
_MASK = (1 << 64) - 1


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rot(acc + lane * _P2, 31) * _P1


def xxh64_slices(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """The XXH64 of each ``data[start:end]`` as uint64."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    at8 = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))
    at4 = np.lib.stride_tricks.as_strided(padded[:4].view(np.uint32), (len(data) + 1,), (1,))
    pos, end = start.astype(np.int64).copy(), end.astype(np.int64)
    size = end - pos
    h = np.full(len(pos), (seed + int(_P5)) & _MASK, np.uint64)
    live = np.flatnonzero(size >= 32)
    if len(live):
        p, e = pos[live].copy(), end[live]
        acc = [
            np.full(len(live), v & _MASK, np.uint64)
            for v in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))
        ]
        on = np.arange(len(live))
        while len(on):
            for j in range(4):
                acc[j][on] = _round(acc[j][on], at8[p[on] + 8 * j])
            p[on] += 32
            on = on[p[on] + 32 <= e[on]]
        total = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
        for a in acc:
            total = (total ^ _round(np.zeros_like(a), a)) * _P1 + _P4
        h[live], pos[live] = total, p
    h += size.astype(np.uint64)
    live = np.flatnonzero(pos + 8 <= end)
    while len(live):
        lane = _round(np.zeros(len(live), np.uint64), at8[pos[live]])
        h[live] = _rot(h[live] ^ lane, 27) * _P1 + _P4
        pos[live] += 8
        live = live[pos[live] + 8 <= end[live]]
    live = np.flatnonzero(pos + 4 <= end)
    h[live] = _rot(h[live] ^ (at4[pos[live]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    pos[live] += 4
    live = np.flatnonzero(pos < end)
    while len(live):
        h[live] = _rot(h[live] ^ (padded[pos[live]].astype(np.uint64) * _P5), 11) * _P1
        pos[live] += 1
        live = live[pos[live] < end[live]]
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    return h
