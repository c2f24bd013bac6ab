"""Word shingles of whole texts as 64-bit numbers, for a batch of documents at a time."""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A pseudo-random number for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _M3)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 19)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = base**a times the hash of bytes a to b."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTES[codes] * up[:-1], out=out[1:])
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingles of each text: words between ASCII white space, A-Z lower-cased.

    A text of fewer words than ``width`` has its whole sequence as one; one without words has none.
    """
    joined = b" ".join([*texts, b""])
    codes = _LOWER[np.frombuffer(joined, np.uint8)]
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    space = _SPACE[codes]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in texts]
    prefix = prefix_hashes(codes)
    _, down = powers(len(codes))
    word = mix((prefix[last] - prefix[first]) * down[first] + (last - first).astype(np.uint64) * _M3)
    at = np.searchsorted(first, starts)  # words before each text
    n = len(word)
    acc = word.copy()
    for k in range(1, min(width, n)):
        acc[: n - k] = mix(acc[: n - k] * _M3 + word[k:] + np.uint64(k))
    out = []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= width:
            x = np.sort(acc[a : b - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            short = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in word[a:b]:
                    short = mix(np.atleast_1d(short * _M2 + w))[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
