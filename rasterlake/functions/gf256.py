"""Reed-Solomon parity over the field of 256 elements: any k of k + m shards give the data back."""

from __future__ import annotations

import numpy as np

_EXP = np.zeros(512, np.uint8)
_LOG = np.zeros(256, np.int64)
_x = 1
for _i in range(255):
    _EXP[_i] = _EXP[_i + 255] = _x
    _LOG[_x] = _i
    _x = (_x << 1) ^ (0x11D if _x & 0x80 else 0)
#: Products of all pairs.
_MUL = np.zeros((256, 256), np.uint8)
_MUL[1:, 1:] = _EXP[_LOG[1:, None] + _LOG[None, 1:]]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((a.shape[0], b.shape[1]), np.uint8)
    for j in range(a.shape[1]):
        out ^= _MUL[a[:, j][:, None], b[j][None, :]]
    return out


def inverse(a: np.ndarray) -> np.ndarray:
    n = len(a)
    work = np.concatenate([a, np.eye(n, dtype=np.uint8)], axis=1)
    for i in range(n):
        p = i + int(np.flatnonzero(work[i:, i])[0])
        work[[i, p]] = work[[p, i]]
        work[i] = _MUL[work[i], _EXP[255 - _LOG[work[i, i]]]]
        for r in range(n):
            if r != i and work[r, i]:
                work[r] ^= _MUL[work[i], work[r, i]]
    return work[:, n:]


def matrix(k: int, m: int) -> np.ndarray:
    """k + m rows of which any k are independent: the identity over a Cauchy matrix."""
    if k < 1 or m < 1 or k + m > 255:
        raise ValueError(f"{k} + {m} shards")
    cauchy = _EXP[(255 - _LOG[(np.arange(k, k + m)[:, None] ^ np.arange(k)[None, :])]) % 255]
    return np.concatenate([np.eye(k, dtype=np.uint8), cauchy])


def parity(data: np.ndarray, m: int) -> np.ndarray:
    """m parity shards of (k, size) data shards."""
    return product(matrix(len(data), m)[len(data) :], data)


def repaired(shards: np.ndarray, good: np.ndarray, k: int) -> np.ndarray:
    """All k + m shards from those that are good (k of them at least)."""
    rows = np.flatnonzero(good)[:k]
    if len(rows) < k:
        raise ValueError(f"{len(rows)} of {k} shards are left")
    full = matrix(k, len(shards) - k)
    return product(full, product(inverse(full[rows]), shards[rows]))
