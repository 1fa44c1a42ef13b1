"""Groups of texts that ask the whole corpus about their keys.

A group is a stretch of a task's texts of bounded size. It names its distinct keys once, dealt to
pieces by hash; pieces add up what all groups have said, and answer each group in the order of its
keys. So corpus statistics of any size are used without handing them to every task. Keys travel as
differences, byte by byte, and texts packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernels

U64 = np.uint64
#: Bytes of text in a group, and of text that is worked on at once.
GROUP_BYTES, STRETCH = 16 << 20, 1 << 20
#: Keys that are held before equal ones are added up.
HELD = 4 << 20
#: Text for each piece, and least and most pieces.
PIECE_BYTES, LEAST_PIECES, MOST_PIECES = 16 << 20, 16, 4096


def pieces_for(size: int) -> int:
    """Pieces for so many bytes of text. Beyond the most, pieces grow, as distinct keys do: slower than texts."""
    return int(min(max(size // PIECE_BYTES, LEAST_PIECES), MOST_PIECES))


def planes(values: np.ndarray) -> bytes:
    """The values byte by byte, all lowest bytes first: what is zero throughout compresses away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unplanes(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return planes(np.diff(keys, prepend=U64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw, U64), dtype=U64)


def piece_of(keys: np.ndarray, pieces: int) -> np.ndarray:
    return (kernels.mix(keys) % U64(pieces)).astype(np.int64)


def by_piece(pieces: int, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """(piece, its ascending keys, their values) of ascending keys."""
    at = piece_of(keys, pieces)
    order = np.argsort(at, kind="stable")
    keys, values = keys[order], [v[order] for v in values]
    ends = np.searchsorted(at[order], np.arange(pieces + 1))
    for p in np.flatnonzero(ends[1:] > ends[:-1]):
        part = slice(ends[p], ends[p + 1])
        yield int(p), keys[part], *(v[part] for v in values)


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The ascending distinct keys of all parts; the list is emptied, so that they are held once."""
    key = np.concatenate(parts)
    parts.clear()
    key.sort()
    return key[np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])] if len(key) else key


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The ascending keys of all parts and their sums; the list is emptied, so that they are held once."""
    key = np.concatenate([k for k, _ in parts])
    n = np.concatenate([x for _, x in parts])
    parts.clear()
    order = np.argsort(key)
    key = key[order]
    n = n[order]
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Tally:
    """Counts by key, added up whenever many are held."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.distinct = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.held += len(keys)
        if self.held > 2 * self.distinct + HELD:
            self.sum()

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        self.parts = [summed(self.parts)] if len(self.parts) > 1 else self.parts
        self.held = self.distinct = len(self.parts[0][0])
        return self.parts[0]


TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def batch(schema: str, size: int, **columns) -> pa.RecordBatch:
    """Columns by name; a scalar stands for all rows, and columns left out are null."""
    out, names = [], []
    for name, kind in (x.split() for x in schema.split(", ")):
        value = columns.get(name)
        if not isinstance(value, (pa.Array, np.ndarray, list)):
            value = [value] * size
        out.append(value.cast(TYPES[kind]) if isinstance(value, pa.Array) else pa.array(value, TYPES[kind]))
        names.append(name)
    return pa.RecordBatch.from_arrays(out, names)


def texts_of(column) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def packed(ids: list, texts: list[bytes]) -> dict:
    """Documents as columns of one row; a size below 0 tells a null id."""
    sizes = np.array([len(t) if i is not None else -1 - len(t) for i, t in zip(ids, texts, strict=True)], np.int64)
    return {"texts": [zlib.compress(b"".join(texts), 1)], "ids": [np.array([i or 0 for i in ids], np.int64).tobytes()], "sizes": [sizes.tobytes()]}


def unpacked(texts: bytes, ids: bytes, sizes: bytes) -> tuple[list, list[bytes]]:
    raw, own, n = zlib.decompress(texts), np.frombuffer(ids, np.int64).tolist(), np.frombuffer(sizes, np.int64)
    ends = np.cumsum(np.where(n < 0, -1 - n, n)).tolist()
    return [i if x >= 0 else None for i, x in zip(own, n, strict=True)], [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Answers:
    """What a group was told: values by key, looked up through a table of slots."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = U64(64 - max(10, int(2 * len(keys)).bit_length()))
        at = self._slot(self.keys)
        self.slots = np.zeros(1 << int(64 - self.shift), np.int32)
        self.slots[at] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """All keys are known: every one was asked for."""
        place = self.slots[self._slot(keys)]
        other = np.flatnonzero(self.keys[place] != keys)
        place[other] = np.searchsorted(self.keys, keys[other])
        return self.values[place]
