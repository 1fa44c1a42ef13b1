"""Vectorised text kernels: words, word hashes and shingle hashes of many texts at once."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np

U64 = np.uint64
#: Texts are worked on in groups of about so many bytes; a longer text is a group of its own, and
#: is cut between words. Words as long as that are hashed apart, so that no array is longer.
GROUP_BYTES = 3 << 19
#: As much text for sets of shingles: arrays of eight bytes a byte of it, and powers for 1 << 19 places.
SET_BYTES = (1 << 19) - 2
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def rising(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_BYTE_LOWER = _BYTE[_LOWER]


def grouped(texts: Iterable[bytes], most: int = GROUP_BYTES) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > most:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield group


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the texts' bytes in one row, start and end of each word there, and each text's first word; one more at the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(joined) and not space[0]:
        edge = np.concatenate([np.zeros(1, np.int64), edge])
    start, end = edge[0::2], edge[1::2]
    return joined, start, end, np.searchsorted(start, np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)]))


def hashed(joined: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the stretches from start to end."""
    up, down = rising(len(joined) + 1)
    total = np.empty(len(joined) + 1, U64)
    total[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[joined] * up[: len(joined)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def cut_text(text: bytes, most: int = GROUP_BYTES) -> Iterator[tuple[bytes, bool]]:
    """A text in pieces of less than `most` bytes, cut after blanks; (word, True) for a word of `most` bytes or more."""
    at, n = 0, len(text)
    while n - at >= most:
        end = max(text.rfind(c, at, at + most) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
        if end >= 0:
            yield text[at : end + 1], False
            at = end + 1
        else:
            found = _BLANK.search(text, at + most)
            end = found.start() if found else n
            yield text[at:end], True
            at = end
    yield text[at:], False


def long_word(word: bytes, lower: bool) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(word.lower() if lower else word, digest_size=8).digest(), U64)


def words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the place of its first word (one more at the end)."""
    if all(len(t) < GROUP_BYTES for t in texts):
        joined, start, end, first = spans(texts)
        return hashed(joined, start, end, lower), first
    found = []
    for t in texts:
        own = [long_word(piece, lower) if long else words([piece], lower)[0] for piece, long in cut_text(t)]
        found.append(np.concatenate(own))
    return np.concatenate(found), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in found])])


_TURN = mix(np.arange(101, 165, dtype=U64)) | U64(1)


def turn(j: int) -> np.uint64:
    """What the hash of the word at place j of a run is multiplied by."""
    return _TURN[j]


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each text's first place among them.

    A text of 1 to k-1 words has one, of all its words; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    out_first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    if not len(hashes):
        return np.zeros(0, U64), out_first
    padded = np.concatenate([hashes, np.zeros(k, U64)])
    rolled = np.zeros(len(hashes), U64)
    for j in range(k):
        rolled += padded[j : j + len(hashes)] * _TURN[j]
    rolled = mix(rolled)
    keep = np.zeros(len(hashes), bool)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(hashes)) - first[owner]
    keep[:] = place < count[owner]
    for i in np.flatnonzero((n > 0) & (n < k)):
        at = first[i]
        h = np.array([n[i]], U64)
        for w in hashes[at : at + n[i]]:
            h = mix(h * U64(_BASE) + w)
        rolled[at] = h[0]
    return rolled[keep], out_first


def shingle_sets(texts: Iterable[bytes], k: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    for group in grouped(texts, SET_BYTES):
        h, first = shingles(*words(group, lower), k)
        owner = np.repeat(np.arange(len(group)), np.diff(first))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
        yield from np.split(h, np.searchsorted(owner, np.arange(1, len(group))))
