"""Sets of word shingles as 64-bit hashes, from the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from . import common

_FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_GAP = np.isin(np.arange(256), [0x20, *range(9, 14)])
_LETTER = common.mix(np.arange(257, 513, dtype=np.uint64))
_P = 0x9E3779B97F4A7C15 | 1
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 19)
        for i, p in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end -> the hash of each word (A-Z as a-z; ASCII white space between words) and the number of its text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _FOLD[data]
    letter = ~_GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[ends] = edge[0] = True
    before, after = np.append(False, letter[:-1]), np.append(letter[1:], False)
    first = np.flatnonzero(letter & (~before | edge[:-1]))
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    power, back = _power(n)
    total = np.append(np.uint64(0), np.cumsum(_LETTER[data] * power[:n]))
    return common.mix((total[end] - total[first]) * back[first]), np.searchsorted(ends, first, "right")


def sets(data: np.ndarray, ends: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    words, owner = word_hashes(data, ends)
    counts = np.bincount(owner, minlength=len(ends))
    bounds = np.append(0, np.cumsum(counts))
    key = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        key = key * _Q + words[j : j + len(key)]
    key = common.mix(key)
    out = []
    for i, n in enumerate(counts.tolist()):
        a = bounds[i]
        if n >= width:
            x = np.sort(key[a : a + n - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            short = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in words[a : a + n]:
                    short = short * _Q + w
            out.append(common.mix(np.array([short])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(x: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return int(common.mix(np.array([common.mix(x ^ _Q).sum(dtype=np.uint64) + np.uint64(len(x)) * np.uint64(_P)])).view(np.int64)[0])
