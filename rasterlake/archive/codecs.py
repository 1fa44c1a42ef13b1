"""Codecs of bytes and the reversible prediction of pixels; codecs are found by the id in a manifest."""

from __future__ import annotations

import lzma
import zlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from ..functions.images import merge_mosaic, split_mosaic
from ..sources.tiff import Spec


class Codec(Protocol):
    """Exactly reversible: decode(encode(x)) == x for all bytes x."""

    id: str

    def encode(self, data: bytes) -> bytes: ...

    def decode(self, data: bytes) -> bytes: ...


@dataclass(frozen=True)
class Identity:
    id: str = "identity"

    def encode(self, data: bytes) -> bytes:
        return data

    def decode(self, data: bytes) -> bytes:
        return data


@dataclass(frozen=True)
class Zlib:
    level: int = 6
    id: str = "zlib"

    def encode(self, data: bytes) -> bytes:
        return zlib.compress(data, self.level)

    def decode(self, data: bytes) -> bytes:
        return zlib.decompress(data)


@dataclass(frozen=True)
class Lzma:
    preset: int = 4
    id: str = "lzma"

    def encode(self, data: bytes) -> bytes:
        return lzma.compress(data, preset=self.preset)

    def decode(self, data: bytes) -> bytes:
        return lzma.decompress(data)


@dataclass(frozen=True)
class Zstd:
    level: int = 9
    id: str = "zstd"

    def encode(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=self.level).compress(data)

    def decode(self, data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)


REGISTRY: dict[str, Codec] = {x.id: x for x in (Identity(), Zlib(), Lzma(), Zstd())}


def register(codec: Codec) -> None:
    REGISTRY[codec.id] = codec


def codec_of(name: str) -> Codec:
    if name not in REGISTRY:
        raise ValueError(f"unknown codec {name}")
    return REGISTRY[name]


def _residues(plane: np.ndarray) -> bytes:
    """Differences from the left neighbour, then from those above; low and high bytes apart."""
    unsigned = plane.astype(f"<u{plane.dtype.itemsize}")
    d = np.diff(unsigned, axis=1, prepend=unsigned[:, :1] * 0)
    d = np.diff(d, axis=0, prepend=d[:1] * 0)
    half = 8 * d.dtype.itemsize - 1
    d = (d << 1) ^ (np.zeros_like(d) - (d >> half))  # small differences of either sign become small numbers
    return np.ascontiguousarray(d).view(np.uint8).reshape(-1, d.dtype.itemsize).T.tobytes()


def _plane(raw: bytes, w: int, h: int, size: int) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f"<u{size}").reshape(h, w)
    d = (d >> 1) ^ (np.zeros_like(d) - (d & 1))
    return np.cumsum(np.cumsum(d, axis=0, dtype=d.dtype), axis=1, dtype=d.dtype)


def _planes(pixels: np.ndarray, spec: Spec) -> list[np.ndarray]:
    if spec.samples == 3:
        return [pixels[:, :, i] for i in range(3)]
    mosaic = spec.layout == "cfa" and spec.width % 2 == 0 and spec.height % 2 == 0
    return split_mosaic(pixels[:, :, 0]) if mosaic else [pixels[:, :, 0]]


def encode_pixels(data: bytes, spec: Spec, codec: Codec) -> list[bytes]:
    size = spec.bits // 8
    pixels = np.frombuffer(data, f"{'<' if spec.le else '>'}u{size}").reshape(spec.height, spec.width, spec.samples)
    return [codec.encode(_residues(p)) for p in _planes(pixels, spec)]


def decode_pixels(parts: list[bytes], spec: Spec, codec: Codec) -> bytes:
    size = spec.bits // 8
    shape = _planes(np.broadcast_to(np.zeros(1, np.uint8), (spec.height, spec.width, spec.samples)), spec)
    planes = [_plane(codec.decode(x), s.shape[1], s.shape[0], size) for x, s in zip(parts, shape, strict=True)]
    out = np.stack(planes, axis=2) if spec.samples == 3 else merge_mosaic(planes) if len(planes) == 4 else planes[0]
    return out.astype(f"{'<' if spec.le else '>'}u{size}").tobytes()
