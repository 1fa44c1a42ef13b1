"""Reading TIFF structures: directories, entries, typed values, layouts; and Exif inside JPEG.

A file is anything with seek and read. Bad structure is told by ValueError with a reason; a bad
entry becomes a row with its reason and the rest of the file is read on.
"""

from __future__ import annotations

import io
import struct
from collections import deque
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from ..functions.dictionaries import TYPES

MAX_DIRECTORIES, MAX_ENTRIES, MAX_VALUES = 64, 4096, 1 << 20
#: Smaller images stay verbatim bytes.
MIN_IMAGE = 1 << 20
BINARY_OVER = 128
SIZES = {code: size for code, _, size in TYPES}
SUB_IFDS, EXIF, GPS, INTEROP = 330, 34665, 34853, 40965
_DTYPES = {1: "u1", 3: "u2", 4: "u4", 6: "i1", 7: "u1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 13: "u4"}


@dataclass
class Entry:
    tag: int
    dtype: int
    count: int
    value_offset: int
    inline: bool
    data: bytes | None
    unreadable: str | None = None


@dataclass
class Directory:
    kind: str
    n: int
    offset: int
    entries: list[Entry] = field(default_factory=list)

    @property
    def label(self) -> str:
        return {"Main": f"IFD{self.n}", "Sub": f"SubIFD{self.n}", "Gps": "GPS"}.get(self.kind, self.kind)

    def first(self, tag: int) -> Entry | None:
        return next((e for e in self.entries if e.tag == tag), None)


class Window:
    """A stretch of a file with places of its own: TIFF offsets count from where the TIFF begins."""

    def __init__(self, f: BinaryIO, base: int, size: int) -> None:
        self.f, self.base, self.size = f, base, size

    def at(self, offset: int, n: int) -> bytes:
        if offset < 0 or n < 0 or offset + n > self.size:
            raise ValueError(f"{n} bytes at {offset} are past the end ({self.size})")
        self.f.seek(self.base + offset)
        out = self.f.read(n)
        if len(out) != n:
            raise ValueError(f"{n} bytes at {offset} cannot be read")
        return out


def size_of(f: BinaryIO) -> int:
    return f.seek(0, io.SEEK_END)


def exif_window(f: BinaryIO) -> Window:
    """The TIFF in a JPEG's APP1 segment."""
    whole = Window(f, 0, size_of(f))
    place = 2
    while True:
        mark, code = whole.at(place, 2)
        if mark != 0xFF or code in (0xDA, 0xD9):
            raise ValueError("JPEG without Exif")
        if code == 0xFF:
            place += 1
            continue
        if code == 0x01 or 0xD0 <= code <= 0xD7:
            place += 2
            continue
        n = int.from_bytes(whole.at(place + 2, 2), "big")
        if n < 2:
            raise ValueError("JPEG segment without a length")
        if code == 0xE1 and n >= 8 and whole.at(place + 4, 6) == b"Exif\0\0":
            return Window(f, place + 10, n - 8)
        place += 2 + n


def window(f: BinaryIO) -> Window:
    """The TIFF of a TIFF or JPEG file."""
    f.seek(0)
    head = f.read(4)
    if head[:2] == b"\xff\xd8":
        return exif_window(f)
    return Window(f, 0, size_of(f))


def order(w: Window) -> str:
    """< or >, if there is a classic TIFF header."""
    head = w.at(0, 4)
    mark = {b"II": "<", b"MM": ">"}.get(head[:2])
    if mark is None or struct.unpack(mark + "H", head[2:])[0] != 42:
        raise ValueError("not a TIFF file")
    return mark


def read_directory(w: Window, mark: str, offset: int, kind: str, n: int) -> tuple[Directory, int]:
    """A directory and the offset of the next."""
    count = struct.unpack(mark + "H", w.at(offset, 2))[0]
    if count > MAX_ENTRIES:
        raise ValueError(f"directory of {count} entries")
    raw = w.at(offset + 2, 12 * count + 4)
    out = Directory(kind, n, offset)
    for i in range(count):
        tag, dtype, values, at = struct.unpack_from(mark + "HHII", raw, 12 * i)
        e = Entry(tag, dtype, values, at, True, None)
        if dtype not in SIZES:
            e.unreadable = f"unknown type {dtype}"
        elif values > MAX_VALUES:
            e.unreadable = f"{values} values"
        else:
            size = SIZES[dtype] * values
            e.inline = size <= 4
            try:
                e.data = raw[12 * i + 8 : 12 * i + 8 + size] if e.inline else w.at(at, size)
            except ValueError as why:
                e.unreadable = str(why)
        out.entries.append(e)
    return out, struct.unpack_from(mark + "I", raw, 12 * count)[0]


def pointers(mark: str, e: Entry) -> list[int]:
    if e.data is None or e.dtype not in (3, 4, 13):
        return []
    return [int(x) for x in np.frombuffer(e.data, mark + _DTYPES[e.dtype])]


def directories(w: Window) -> tuple[str, list[Directory]]:
    """All directories, breadth first, each once: the chain, sub-directories, Exif, GPS, interop."""
    mark = order(w)
    first = struct.unpack(mark + "I", w.at(4, 4))[0]
    todo, seen, out = deque([("Main", first)]), set(), []
    numbers = {"Main": 0, "Sub": 0}
    while todo and len(out) < MAX_DIRECTORIES:
        kind, offset = todo.popleft()
        if offset == 0 or offset in seen:
            continue
        seen.add(offset)
        try:
            d, after = read_directory(w, mark, offset, kind, numbers.get(kind, 0))
        except ValueError:
            if not out:
                raise
            continue
        numbers[kind] = numbers.get(kind, 0) + 1
        out.append(d)
        for e in d.entries:
            to = {SUB_IFDS: "Sub", EXIF: "Exif", GPS: "Gps", INTEROP: "Interop"}.get(e.tag)
            if to:
                todo += [(to, x) for x in pointers(mark, e)]
        if kind == "Main" and after:
            todo.append(("Main", after))
    return mark, out


def value(mark: str, e: Entry) -> dict:
    """An entry's value: tag is text, ints, rats, reals, binary or unreadable, and its field is filled."""
    if e.data is None:
        return {"tag": "unreadable", "why": e.unreadable}
    if e.dtype == 2:
        return {"tag": "text", "text": e.data.split(b"\0")[0].decode("utf-8", "replace").rstrip()}
    if e.dtype in (1, 7) and len(e.data) > BINARY_OVER:
        return {"tag": "binary", "bin_len": len(e.data)}
    if e.dtype == 7 and e.data and all(32 <= x < 127 or x == 0 for x in e.data):
        return {"tag": "text", "text": e.data.split(b"\0")[0].decode("ascii").rstrip()}
    if e.dtype in (5, 10):
        x = np.frombuffer(e.data, mark + ("u4" if e.dtype == 5 else "i4")).astype(np.int64).reshape(-1, 2)
        return {"tag": "rats", "rats": [{"n": int(n), "d": int(d)} for n, d in x]}
    x = np.frombuffer(e.data, mark + _DTYPES[e.dtype])
    return {"tag": "reals", "reals": x.astype(float).tolist()} if e.dtype in (11, 12) else {"tag": "ints", "ints": x.astype(np.int64).tolist()}


@dataclass(frozen=True)
class Spec:
    """Pixels of a segment: samples are 1 (a colour mosaic) or 3 (interleaved)."""

    width: int
    height: int
    bits: int
    samples: int
    layout: str
    le: bool

    @property
    def size(self) -> int:
        return self.width * self.height * self.samples * (self.bits // 8)


@dataclass(frozen=True)
class Segment:
    offset: int
    len: int
    spec: Spec | None = None


def _ints(mark: str, d: Directory, tag: int) -> list[int]:
    e = d.first(tag)
    return [] if e is None or e.data is None or e.dtype not in (1, 3, 4, 13) else [int(x) for x in np.frombuffer(e.data, mark + _DTYPES[e.dtype])]


def image_region(mark: str, d: Directory, size: int) -> Segment | None:
    """The directory's pixels, if they are plain bytes in one stretch: uncompressed RGB or mosaic of 8 or 16 bits."""
    one = lambda tag, default=None: next(iter(_ints(mark, d, tag)), default)
    width, height, photometric, samples = one(256), one(257), one(262), one(277, 1)
    bits = set(_ints(mark, d, 258) or [1])
    if not width or not height or one(259, 1) != 1 or one(284, 1) != 1 or len(bits) != 1 or (photometric, samples) not in ((2, 3), (32803, 1)):
        return None
    spec = Spec(width, height, bits.pop(), samples, "cfa" if photometric == 32803 else "chunky", mark == "<")
    starts, lens = _ints(mark, d, 273), _ints(mark, d, 279)
    if spec.bits not in (8, 16) or not starts or len(starts) != len(lens):
        return None
    whole = all(a + n == b for a, n, b in zip(starts, lens, starts[1:], strict=False))
    if not whole or sum(lens) != spec.size or spec.size < MIN_IMAGE or starts[0] + spec.size > size:
        return None
    return Segment(starts[0], spec.size, spec)


def layout(f: BinaryIO) -> tuple[int, int, list[Segment]]:
    """(total length, orientation, gapless segments) of a TIFF file."""
    size = size_of(f)
    w = Window(f, 0, size)
    mark, found = directories(w)
    regions = sorted((r for d in found if d.kind in ("Main", "Sub") and (r := image_region(mark, d, size))), key=lambda r: r.offset)
    turn = next(iter(_ints(mark, found[0], 274)), 1)
    out, place = [], 0
    for r in regions:
        if r.offset < place:
            raise ValueError("images overlap")
        if r.offset > place:
            out.append(Segment(place, r.offset - place))
        out.append(r)
        place = r.offset + r.len
    if size > place:
        out.append(Segment(place, size - place))
    return size, turn if 1 <= turn <= 8 else 1, out
