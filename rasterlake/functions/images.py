"""Whole images as numpy: mosaics, downscaling in linear light, orientation, PNG."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .colour import curve, finished


def split_mosaic(a: np.ndarray) -> list[np.ndarray]:
    """Four planes of half the sides: even and odd columns of even rows, then of odd rows."""
    if a.shape[0] % 2 or a.shape[1] % 2:
        raise ValueError(f"{a.shape[1]} x {a.shape[0]} has no whole 2 x 2 cells")
    return [a[y::2, x::2] for y in (0, 1) for x in (0, 1)]


def merge_mosaic(planes: list[np.ndarray]) -> np.ndarray:
    h, w = planes[0].shape
    out = np.empty((2 * h, 2 * w), planes[0].dtype)
    for p, (y, x) in zip(planes, ((0, 0), (0, 1), (1, 0), (1, 1)), strict=True):
        out[y::2, x::2] = p
    return out


def fit(w: int, h: int, edge: int) -> tuple[int, int]:
    longest = max(w, h)
    if longest <= edge or not longest:
        return max(w, 1), max(h, 1)
    return max(int(w * edge / longest + 0.5), 1), max(int(h * edge / longest + 0.5), 1)


def _means(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Sums over the source rows that each of n target rows touches, and how many they are."""
    size = a.shape[axis]
    i = np.arange(n)
    low = i * size // n
    high = np.maximum(np.minimum(-(-(i + 1) * size // n), size), low + 1)
    total = np.concatenate([np.zeros_like(np.take(a, [0], axis)), np.cumsum(a, axis)], axis)
    count = (high - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    return (np.take(total, high, axis) - np.take(total, low, axis)) / count


def area_means(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """(h, w, ...) means over the source pixels that each target pixel touches."""
    return _means(_means(a, h, 0), w, 1)


def downscaled(rgb: np.ndarray, w: int, h: int, transfer: str = "srgb") -> np.ndarray:
    """(h, w, 3) linear light of an (H, W, 3) image of 8 or 16 bits, by area means.

    Plain images of 16 bits go by their high bytes; HDR ones by all bits.
    """
    if rgb.dtype.itemsize == 2 and transfer == "srgb":
        rgb = (rgb >> 8).astype(np.uint8)
    light = curve(transfer, rgb.astype(np.float64) / (65535 if rgb.dtype.itemsize == 2 else 255))
    return area_means(light, w, h)


def upright(a: np.ndarray, orientation: int) -> np.ndarray:
    """An image stored with an orientation of 1 to 8 as it is to be seen."""
    if orientation in (5, 6, 7, 8):
        a = a.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        a = a[:, ::-1]
    if orientation in (3, 4, 7, 8):
        a = a[::-1]
    return a


def png(rgb: np.ndarray) -> bytes:
    """An (h, w, 3) image of bytes as PNG."""
    h, w, _ = rgb.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, 3 * w)], axis=1).tobytes()
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def preview(rgb: np.ndarray, orientation: int = 1, edge: int = 512, transfer: str = "srgb", bt2020: bool = False) -> bytes:
    """An upright PNG of at most edge pixels a side."""
    h, w, _ = rgb.shape
    light = downscaled(rgb, *fit(w, h, edge), transfer)
    return png(upright(finished(light, transfer != "srgb", bt2020), orientation))
