"""Image files made in memory."""

import struct

import numpy as np


def tiff(entries, extra=b"", mark="<", after=0, sub=()):
    """A TIFF of one directory at 8. entries: (tag, dtype, count, value as number or bytes).

    Bytes that don't fit in an entry are put behind the directory; `extra` follows them.
    """
    head = (b"II" if mark == "<" else b"MM") + struct.pack(mark + "HI", 42, 8)
    entries = sorted(entries)
    place = 8 + 2 + 12 * len(entries) + 4
    body, tail = struct.pack(mark + "H", len(entries)), b""
    for tag, dtype, count, value in entries:
        if isinstance(value, bytes):
            if len(value) > 4:
                raw = struct.pack(mark + "I", place + len(tail))
                tail += value
            else:
                raw = value.ljust(4, b"\0")
        elif dtype == 3 and count == 1:
            raw = struct.pack(mark + "HH", value, 0)
        else:
            raw = struct.pack(mark + "I", value)
        body += struct.pack(mark + "HHI", tag, dtype, count) + raw
    return head + body + struct.pack(mark + "I", after) + tail + extra


def image(w, h, samples, photometric, bits=16, seed=1, orientation=1):
    """A TIFF with plain pixels and a trailer, and the pixels."""
    rng = np.random.default_rng(seed)
    smooth = np.cumsum(rng.integers(-3, 4, (h, w * samples)), axis=1) + 2000
    pixels = smooth.astype(f"<u{bits // 8}").tobytes()
    n = 9
    start = 8 + 2 + 12 * n + 4 + (6 if samples == 3 else 0)
    spec = struct.pack("<HHH", bits, bits, bits) if samples == 3 else bits
    rows = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, samples, spec), (259, 3, 1, 1), (262, 3, 1, photometric), (273, 4, 1, start), (274, 3, 1, orientation), (277, 3, 1, samples), (279, 4, 1, len(pixels))]
    return tiff(rows, pixels + b"trailing-metadata"), pixels


def jpeg(inner):
    app1 = b"Exif\0\0" + inner
    return b"\xff\xd8\xff\xe0\0\x04ab" + b"\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def icc(tags, signature=b"acsp", count=None):
    head = bytearray(128)
    head[8:10], head[12:16], head[36:40] = b"\x04\x30", b"mntr", signature
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, raw in tags:
        table += name + struct.pack(">II", at + len(body), len(raw))
        body += raw
    return bytes(head) + struct.pack(">I", len(tags) if count is None else count) + table + body
