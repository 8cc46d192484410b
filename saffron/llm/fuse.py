"""Static 3-wise binary-fuse filters over 64-bit keys, with numpy.

A filter answers "may hold" for all its keys, and for about 1 in 256 others. It
is built once from the keys of an immutable snapshot and takes about 9 bits a key.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ _U(seed)
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots for each key, in three neighbouring segments: (3, n)."""
    first = (h >> _U(40)) % _U(count)
    parts = [h & _U(0xFFFFF), (h >> _U(20)) & _U(0xFFFFF), mix(h, 7) & _U(0xFFFFF)]
    return np.stack([((first + _U(i)) * _U(segment) + p % _U(segment)) for i, p in enumerate(parts)]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return (mix(h, 11) & _U(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the distinct keys: seed, segment length, segments, fingerprints."""
    keys = np.unique(np.asarray(keys, dtype=_U))
    n = len(keys)
    segment = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    segments = max(1, -(-int(n * factor) // segment) - 2) + 2
    for seed in range(1, 1000):
        h = mix(keys, seed)
        slots = _slots(h, segment, segments - 2)
        size = segments * segment
        count = np.bincount(slots.ravel(), minlength=size)
        held = np.zeros(size, _U)
        order = np.arange(n, dtype=_U)
        for row in slots:
            np.bitwise_xor.at(held, row, order)
        layers, left = [], n
        while left:
            alone = np.flatnonzero(count == 1)
            if not len(alone):
                break
            who, at = np.unique(held[alone].astype(np.int64), return_index=True)
            layers.append((who, alone[at]))
            left -= len(who)
            for row in slots[:, who]:
                np.subtract.at(count, row, 1)
                np.bitwise_xor.at(held, row, who.astype(_U))
        if left:
            segments += 1 + segments // 16  # another seed and a little more room
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for who, at in reversed(layers):  # keys of a layer share no slot that is still to be set
            table[at] = 0
            s = slots[:, who]
            table[at] = prints[who] ^ table[s[0]] ^ table[s[1]] ^ table[s[2]]
        return np.array([seed, segment, segments], "<u4").tobytes() + table.tobytes()
    raise RuntimeError("no filter found")


def may_hold(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be among the filter's keys; never false for one that is."""
    seed, segment, segments = (int(x) for x in np.frombuffer(filter_bytes, "<u4", 3))
    table = np.frombuffer(filter_bytes, np.uint8, offset=12)
    h = mix(np.asarray(keys, dtype=_U), seed)
    s = _slots(h, segment, segments - 2)
    return (table[s[0]] ^ table[s[1]] ^ table[s[2]]) == _prints(h)
