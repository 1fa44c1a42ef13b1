"""The archive format: preview, magic, body, three manifests, parity, three footers.

An archive holds what is needed to give the file back exactly, and is checked before it is used:
pack() decodes what it made and compares. The last intact footer and the first manifest with the
right digest are used; parity covers everything before it and repairs up to `parity` bad shards of
each stripe. Errors are ArchiveError with a code.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import zlib
from bisect import bisect_right
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from typing import BinaryIO

import numpy as np

from ..functions import gf256
from ..sources import tiff
from . import codecs

MAGIC, FOOT = b"RLARC1\r\n", b"RLFT"
VERSION, COPIES = 1, 3
_FOOTER = struct.Struct("<4sHHIQIQ8sI")
FOOTER_SIZE = _FOOTER.size


class ArchiveError(ValueError):
    def __init__(self, code: str, detail: str) -> None:
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


@dataclass(frozen=True)
class Parity:
    data: int = 32
    parity: int = 2
    shard: int = 65_536

    def __post_init__(self) -> None:
        if self.data < 1 or self.parity < 1 or self.data + self.parity > 255 or self.shard < 64 or self.shard % 64:
            raise ArchiveError("parity", f"{self.data} + {self.parity} shards of {self.shard}")


@dataclass(frozen=True)
class Footer:
    preview: int
    body: int
    manifest: int
    parity: int
    digest: bytes

    def packed(self) -> bytes:
        head = _FOOTER.pack(FOOT, VERSION, 0, self.preview, self.body, self.manifest, self.parity, self.digest, 0)[:-4]
        return head + struct.pack("<I", zlib.crc32(head))

    @property
    def protected(self) -> int:
        return self.preview + len(MAGIC) + self.body + COPIES * self.manifest


def segments_of(data: bytes) -> tuple[str, int, list[tiff.Segment]]:
    """(container, orientation, segments); what can't be read as TIFF is one stretch of bytes."""
    try:
        _, turn, found = tiff.layout(io.BytesIO(data))
        return "tiff", turn, found
    except ValueError:
        return "bytes", 1, [tiff.Segment(0, len(data))] if data else []


def now() -> str:
    """The time in UTC, as a manifest tells it."""
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def pack(data: bytes, name: str = "", codec: str = "zlib", parity: Parity | None = None, preview: bytes = b"", made: str | None = None) -> bytes:
    """An archive of data that has been decoded and compared. made: the time in its provenance, now if not given."""
    own = codecs.codec_of(codec)
    container, turn, found = segments_of(data)
    body, listed = [], []
    for s in found:
        raw = data[s.offset : s.offset + s.len]
        parts = codecs.encode_pixels(raw, s.spec, own) if s.spec else [own.encode(raw)]
        body += parts
        listed.append({"offset": s.offset, "len": s.len, "codec": codec, "parts": [len(p) for p in parts], "spec": asdict(s.spec) if s.spec else None})
    inside = b"".join(body)
    manifest = {"version": VERSION, "container": container, "orientation": turn, "original": {"name": name, "len": len(data), "sha256": hashlib.sha256(data).hexdigest()}, "body": {"len": len(inside), "sha256": hashlib.sha256(inside).hexdigest()}, "segments": listed, "provenance": {"software": "rasterlake", "codec": codec, "made": made or now()}, "parity": asdict(parity) if parity else None}
    text = json.dumps(manifest, separators=(",", ":")).encode()
    head = preview + MAGIC + inside + text * COPIES
    extra = _parity_section(head, parity) if parity else b""
    out = head + extra + Footer(len(preview), len(inside), len(text), len(extra), hashlib.sha256(text).digest()[:8]).packed() * COPIES
    if unpack(out) != data:
        raise ArchiveError("roundtrip", "the archive does not give the file back")
    return out


def footer(raw: bytes, total: int | None = None) -> Footer:
    """The last intact copy; raw may be an archive's end alone, of `total` bytes in all."""
    for i in range(COPIES):
        at = len(raw) - _FOOTER.size * (i + 1)
        if at < 0:
            break
        mark, version, _, preview, body, manifest, parity, digest, crc = _FOOTER.unpack_from(raw, at)
        if mark == FOOT and crc == zlib.crc32(raw[at : at + _FOOTER.size - 4]):
            if version > VERSION:
                raise ArchiveError("version", f"format {version}")
            f = Footer(preview, body, manifest, parity, digest)
            if f.protected + parity + COPIES * _FOOTER.size != (len(raw) if total is None else total):
                raise ArchiveError("truncated", f"{len(raw) if total is None else total} bytes")
            return f
    raise ArchiveError("footer", "no intact footer")


def is_archive(raw: bytes) -> bool:
    try:
        f = footer(raw)
    except ArchiveError:
        return False
    return raw[f.preview : f.preview + len(MAGIC)] == MAGIC


def manifest(raw: bytes) -> dict:
    """The first copy with the right digest."""
    f = footer(raw)
    at = f.preview + len(MAGIC) + f.body
    return _manifest([raw[at + i * f.manifest : at + (i + 1) * f.manifest] for i in range(COPIES)], f.digest)


def _manifest(copies: list[bytes], digest: bytes) -> dict:
    for text in copies:
        if hashlib.sha256(text).digest()[:8] == digest:
            out = {"provenance": None, "parity": None, "orientation": 1} | json.loads(text)
            if out["version"] > VERSION:
                raise ArchiveError("version", f"manifest {out['version']}")
            return out
    raise ArchiveError("manifest", "no intact manifest")


def _body(raw: bytes) -> bytes:
    f = footer(raw)
    return raw[f.preview + len(MAGIC) : f.preview + len(MAGIC) + f.body]


def unpack(raw: bytes) -> bytes:
    """The file, with length and digest checked."""
    m, body = manifest(raw), _body(raw)
    out, place = [], 0
    for s in m["segments"]:
        parts = []
        for n in s["parts"]:
            parts.append(body[place : place + n])
            place += n
        codec = codecs.codec_of(s["codec"])
        try:
            out.append(codecs.decode_pixels(parts, tiff.Spec(**s["spec"]), codec) if s["spec"] else codec.decode(parts[0]))
        except ArchiveError:
            raise
        except Exception as why:
            raise ArchiveError("corrupt", f"segment at {s['offset']}: {why}") from why
    data = b"".join(out)
    if len(data) != m["original"]["len"]:
        raise ArchiveError("length", f"{len(data)} bytes instead of {m['original']['len']}")
    if hashlib.sha256(data).hexdigest() != m["original"]["sha256"]:
        raise ArchiveError("digest", "the file's digest differs")
    return data


def verify(raw: bytes, quick: bool = False) -> dict:
    """The manifest, once the stored bytes (quick) or the whole file have been found right."""
    m = manifest(raw)
    if quick:
        if hashlib.sha256(_body(raw)).hexdigest() != m["body"]["sha256"]:
            raise ArchiveError("body", "the stored bytes' digest differs")
    else:
        unpack(raw)
    return m


def skeleton(raw: bytes) -> bytes:
    """The original's bytes, with zeros for pixels, without decoding any."""
    m, body = manifest(raw), _body(raw)
    out, place = [], 0
    for s in m["segments"]:
        n = sum(s["parts"])
        out.append(bytes(s["len"]) if s["spec"] else codecs.codec_of(s["codec"]).decode(body[place : place + n]))
        place += n
    return b"".join(out)


class Skeleton(io.RawIOBase):
    """The original's bytes, with zeros for pixels, as a file to seek and read: only what is read is decoded.

    Takes an archive as a file; holds its manifest and one decoded stretch of bytes at a time.
    """

    def __init__(self, f: BinaryIO) -> None:
        size = tiff.size_of(f)
        f.seek(max(0, size - COPIES * FOOTER_SIZE))
        foot = footer(f.read(COPIES * FOOTER_SIZE), size)
        self.f, self.body, self.place = f, foot.preview + len(MAGIC), 0
        f.seek(self.body + foot.body)
        text = f.read(foot.manifest * COPIES)
        self.manifest = _manifest([text[i * foot.manifest : (i + 1) * foot.manifest] for i in range(COPIES)], foot.digest)
        self.size = self.manifest["original"]["len"]
        self.segments, at = [], 0
        for s in self.manifest["segments"]:
            self.segments.append((s["offset"], at, sum(s["parts"]), s))
            at += sum(s["parts"])
        self.held: tuple[int, bytes] = (-1, b"")

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.size}[whence]
        return self.place

    def tell(self) -> int:
        return self.place

    def read(self, n: int = -1) -> bytes:
        end = self.size if n is None or n < 0 else min(self.place + n, self.size)
        out = []
        while self.place < end:
            i = bisect_right(self.segments, self.place, key=lambda s: s[0]) - 1
            offset, at, stored, s = self.segments[i]
            stop = min(end, offset + s["len"])
            if s["spec"]:
                out.append(bytes(stop - self.place))
            else:
                if self.held[0] != i:
                    self.f.seek(self.body + at)
                    self.held = (i, codecs.codec_of(s["codec"]).decode(self.f.read(stored)))
                out.append(self.held[1][self.place - offset : stop - offset])
            self.place = stop
        return b"".join(out)


def _shards(head: bytes, p: Parity) -> np.ndarray:
    """(stripes, data, shard) bytes, zeros at the end."""
    n = max(-(-len(head) // p.shard), 1)
    stripes = -(-n // p.data)
    out = np.zeros(stripes * p.data * p.shard, np.uint8)
    out[: len(head)] = np.frombuffer(head, np.uint8)
    return out.reshape(stripes, p.data, p.shard)


def _checks(shards: np.ndarray) -> np.ndarray:
    return np.array([[zlib.crc32(s.tobytes()) for s in stripe] for stripe in shards], np.uint32)


def _parity_section(head: bytes, p: Parity) -> bytes:
    """Checksums of all shards, twice, and the parity shards."""
    data = _shards(head, p)
    extra = np.stack([gf256.parity(s, p.parity) for s in data])
    table = np.concatenate([_checks(data), _checks(extra)], axis=1).tobytes()
    table += struct.pack("<I", zlib.crc32(table))
    return struct.pack("<III", p.data, p.parity, p.shard) + table * 2 + extra.tobytes()


def _section(raw: bytes) -> tuple[Footer, Parity, np.ndarray, np.ndarray]:
    """(footer, configuration, all shards by stripe, which are good)."""
    f = footer(raw)
    if not f.parity:
        raise ArchiveError("parity", "the archive has no parity")
    section = raw[f.protected : f.protected + f.parity]
    p = Parity(*struct.unpack_from("<III", section))
    data = _shards(raw[: f.protected], p)
    size = len(data) * (p.data + p.parity) * 4 + 4
    tables = (section[12 + i * size : 12 + (i + 1) * size] for i in range(2))
    table = next((t for t in tables if zlib.crc32(t[:-4]) == struct.unpack("<I", t[-4:])[0]), None)
    if table is None:
        raise ArchiveError("parity", "no intact checksums")
    extra = np.frombuffer(section[12 + 2 * size :], np.uint8).reshape(len(data), p.parity, p.shard)
    every = np.concatenate([data, extra], axis=1)
    return f, p, every, _checks(every) == np.frombuffer(table[:-4], np.uint32).reshape(len(data), -1)


def scan(raw: bytes) -> list[tuple[int, int, int, bool]]:
    """(stripe, bad data shards, bad parity shards, repairable) of each damaged stripe."""
    _, p, _, good = _section(raw)
    bad = ~good
    return [(i, int(b[: p.data].sum()), int(b[p.data :].sum()), int(b.sum()) <= p.parity) for i, b in enumerate(bad) if b.any()]


def patches(raw: bytes) -> list[tuple[int, bytes]]:
    """(place, bytes) of what repairs an archive: damaged shards made again, one stripe at a time, then any damaged
    checksum table and footer. ArchiveError if a stripe has too many bad shards."""
    f, p, every, good = _section(raw)
    stripes, out = len(every), []
    bad = np.flatnonzero(~good.all(axis=1))
    for i in bad:
        if (~good[i]).sum() > p.parity:
            raise ArchiveError("unrepairable", f"stripe {i}: {int((~good[i]).sum())} bad shards")
    size = stripes * (p.data + p.parity) * 4 + 4
    extra = f.protected + 12 + 2 * size
    sums = _checks(every)
    for i in bad:
        whole = gf256.repaired(every[i].copy(), good[i], p.data)
        sums[i] = _checks(whole[None])[0]
        for j in np.flatnonzero(~good[i]):
            at = (i * p.data + j) * p.shard if j < p.data else extra + (i * p.parity + j - p.data) * p.shard
            end = min(at + p.shard, f.protected) if j < p.data else at + p.shard
            if end > at:
                out.append((int(at), whole[j].tobytes()[: end - at]))
    table = sums.astype(np.uint32).tobytes()
    table += struct.pack("<I", zlib.crc32(table))
    for at, right in ((f.protected, struct.pack("<III", p.data, p.parity, p.shard) + table * 2), (len(raw) - COPIES * FOOTER_SIZE, f.packed() * COPIES)):
        if raw[at : at + len(right)] != right:
            out.append((at, right))
    return out


def repair(raw: bytes) -> bytes:
    """The archive with its patches."""
    out = bytearray(raw)
    for at, right in patches(raw):
        out[at : at + len(right)] = right
    return bytes(out)


def preview_of(f: BinaryIO) -> bytes:
    """The preview that an archive begins with, read alone; empty if it has none."""
    size = tiff.size_of(f)
    f.seek(max(0, size - COPIES * FOOTER_SIZE))
    foot = footer(f.read(COPIES * FOOTER_SIZE), size)
    f.seek(0)
    return f.read(foot.preview)
