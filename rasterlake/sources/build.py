"""Writing small TIFF structures, JPEG wrappers and colour profiles: what readers are tried on, and examples.

Values: text for ASCII, numbers for whole types, (numerator, denominator) pairs for fractions, bytes
for undefined ones.
"""

from __future__ import annotations

import struct

SHORT, LONG, RATIONAL, ASCII, UNDEFINED, DOUBLE = 3, 4, 5, 2, 7, 12
_ITEM = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}


def _encoded(mark: str, dtype: int, value) -> tuple[int, bytes]:
    """(count, bytes) of an entry's value."""
    if dtype == ASCII:
        raw = value.encode() + b"\0"
        return len(raw), raw
    if dtype == UNDEFINED:
        return len(value), bytes(value)
    if dtype in (5, 10):
        items = value if isinstance(value, list) else [value]
        return len(items), b"".join(struct.pack(mark + ("II" if dtype == 5 else "ii"), *x) for x in items)
    items = list(value) if isinstance(value, (list, tuple)) else [value]
    return len(items), struct.pack(f"{mark}{len(items)}{_ITEM[dtype]}", *items)


class Tiff:
    """A TIFF that grows at its end; the main directory is the one written last."""

    def __init__(self, mark: str = "<") -> None:
        self.mark = mark
        self.raw = bytearray((b"II" if mark == "<" else b"MM") + struct.pack(mark + "HI", 42, 8))

    def put(self, data: bytes) -> int:
        """Where data has been put, at an even place."""
        at = len(self.raw) + len(self.raw) % 2
        self.raw += bytes(at - len(self.raw)) + data
        return at

    def directory(self, entries: list[tuple], after: int = 0) -> int:
        """Where a directory of (tag, type, value) has been put. after: the next one of its chain."""
        rows = []
        for tag, dtype, value in sorted(entries, key=lambda e: e[0]):
            count, data = _encoded(self.mark, dtype, value)
            field = data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(self.mark + "I", self.put(data))
            rows.append(struct.pack(self.mark + "HHI", tag, dtype, count) + field)
        return self.put(struct.pack(self.mark + "H", len(rows)) + b"".join(rows) + struct.pack(self.mark + "I", after))

    def done(self, main: int, trailer: bytes = b"") -> bytes:
        self.raw[4:8] = struct.pack(self.mark + "I", main)
        return bytes(self.raw) + trailer


def jpeg(tiff: bytes) -> bytes:
    """A JPEG of nothing but the Exif segment that holds a TIFF."""
    inner = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(inner) + 2) + inner + b"\xff\xd9"


def colour_profile(primaries: int | None = None, transfer: int | None = None, description: str | None = None) -> bytes:
    """A colour profile with coding-independent code points, a description, or both."""
    tags = []
    if description is not None:
        text = description.encode("utf-16-be")
        tags.append((b"desc", b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(text), 28) + text))
    if primaries is not None:
        tags.append((b"cicp", b"cicp" + bytes(4) + bytes([primaries, transfer, 0, 1])))
    head = bytearray(128)
    head[8:10], head[12:16], head[36:40] = b"\x04\x30", b"mntr", b"acsp"
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, raw in tags:
        table += name + struct.pack(">II", at + len(body), len(raw))
        body += raw
    return bytes(head) + struct.pack(">I", len(tags)) + table + body
