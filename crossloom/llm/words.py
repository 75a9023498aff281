"""Words, hashes and shingles of many documents at once, as flat numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = 0x9E3779B97F4A7C15 | 5
_P_INV = pow(_P, -1, 2**64)
_STEP = [int(x) | 1 for x in _RNG.integers(1, 2**63, 64, dtype=np.uint64)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_HASH_OF = _BYTE[LOWER]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64, for i < n at least."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        out = []
        with np.errstate(over="ignore"):
            for base in (_P, _P_INV):
                a = np.ones(size, U)
                done = 1
                step = base
                while done < size:
                    a[done : 2 * done] = a[:done] * U(step)
                    step = step * step % 2**64
                    done *= 2
                out.append(a)
        have = (out[0], out[1])
        if size <= 1 << 23:
            _powers[0] = have
    return have


def prefix_hash(flat: np.ndarray, table: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of table[flat[j]] * P**j."""
    pw, _ = powers(len(flat) + 1)
    s = np.zeros(len(flat) + 1, U)
    with np.errstate(over="ignore"):
        np.cumsum(table[flat] * pw[: len(flat)], out=s[1:])
    return s


def span_hash(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of flat[starts:ends], from prefix_hash."""
    _, inv = powers(len(s))
    with np.errstate(over="ignore"):
        return mix((s[ends] - s[starts]) * inv[starts] + (ends - starts).astype(U) * U(_STEP[63]))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in order, for each document the index of its first word and one end, positions)."""
    if not len(flat):
        return np.empty(0, U), np.zeros(len(offsets), np.int64), np.empty((2, 0), np.int64)
    solid = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(flat), bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.zeros(len(flat), bool)
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    h = span_hash(prefix_hash(flat, _HASH_OF), starts, ends)
    return h, np.searchsorted(starts, offsets), np.stack([starts, ends])


def shingle_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size word hashes; a shorter non-empty text is one shingle as a whole."""
    if not len(h):
        return h
    k = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, U(k))
        for j in range(k):
            out += h[j : j + len(out)] * U(_STEP[j % 48]) * U(2 * (j // 48) + 1)
        return mix(out)
