"""Archives over many files: a file is a row, and a bad one is a row with a status, not a failed job.

Files are opened by path in the tasks, one at a time; outputs are written under temporary names
and renamed when complete, so that a task may be run again.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images
from ..operators import stats
from ..sources import icc, tiff
from . import format as fmt

RESULT = "path string, target string, original long, stored long, payload_len long, skeleton_len long, sha256 string, status string, seconds double, peak_rss long, error_code string, error_detail string"
#: Bytes that are read and hashed at once, and the sides of the preview that an archive begins with.
CHUNK, PREVIEW_EDGE = 1 << 20, 512


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:") or "://" not in uri:
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Counted:
    """A writer that counts and hashes what goes through it."""

    def __init__(self, to: BinaryIO | None = None) -> None:
        self.to, self.size, self._sha = to, 0, hashlib.sha256()

    def write(self, data: bytes) -> int:
        self._sha.update(data)
        self.size += len(data)
        if self.to is not None:
            self.to.write(data)
        return len(data)

    @property
    def digest(self) -> str:
        return self._sha.hexdigest()


def copied(source: BinaryIO, to: BinaryIO | None = None, chunk: int = CHUNK) -> tuple[int, str]:
    """(bytes, SHA-256) of a stream that is copied chunk by chunk, or only read."""
    out = Counted(to)
    while data := source.read(chunk):
        out.write(data)
    return out.size, out.digest


def read_bytes(uri: str) -> bytes:
    fs, at = open_fs(uri)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def write_bytes(uri: str, data: bytes, overwrite: bool = False) -> None:
    fs, at = open_fs(uri)
    if not overwrite and fs.get_file_info(at).type != pafs.FileType.NotFound:
        raise fmt.ArchiveError("exists", uri)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    temp = f"{at}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, at)


def archive_name(path: str) -> str:
    """a.tif becomes a.rla.tif."""
    folder, _, name = path.rpartition("/")
    stem, dot, end = name.rpartition(".")
    return f"{folder}/" * bool(folder) + (f"{stem}.rla.{end}" if dot and stem else f"{name}.rla")


@F.pandas_udf(T.StringType())
def derived_names(names: pd.Series) -> pd.Series:
    """archive_name() of a column; null for null."""
    return names.map(lambda n: None if n is None else archive_name(n))


def _each(files: DataFrame, work: Callable[[str], tuple[str | None, int, int, dict | None, str]]) -> DataFrame:
    """A row of RESULT for each file. work: (target, original, stored, manifest or None, status) of a path."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    by_name = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    kinds = [by_name[x.split()[1]] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                began = time.perf_counter()
                took = lambda: (time.perf_counter() - began, stats.peak_rss())  # noqa: B023, E731
                try:
                    target, original, stored, m, status = work(path)
                    payload = None if m is None else sum(s["len"] for s in m["segments"] if s["spec"])
                    row = (path, target, original, stored, payload, None if m is None else original - payload, None if m is None else m["original"]["sha256"], status, *took(), None, None)
                except fmt.ArchiveError as why:
                    row = (path, *[None] * 6, "FAILED", *took(), why.code, why.detail)
                except OSError as why:
                    row = (path, *[None] * 6, "FAILED", *took(), "io", str(why))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return files.select("path").mapInArrow(run, RESULT)


def _first_preview(data: bytes, edge: int) -> bytes:
    """The picture that an archive begins with; empty where a file has no image to make it from."""
    try:
        own, pixels, turn, bare = _picture(data)
        return _png(own, pixels, turn, bare, edge)
    except (fmt.ArchiveError, ValueError):
        return b""


def archive(files: DataFrame, folder: str, codec: str = "zlib", parity: fmt.Parity | None = None, edge: int = PREVIEW_EDGE) -> DataFrame:
    """An archive of each file in folder, beginning with a preview of at most edge pixels a side (none for 0)."""
    def work(path: str):
        data = read_bytes(path)
        raw = fmt.pack(data, path.rpartition("/")[2], codec, parity, _first_preview(data, edge) if edge else b"")
        target = f"{folder}/{archive_name(path.rpartition('/')[2])}"
        write_bytes(target, raw, overwrite=True)
        return target, len(data), len(raw), fmt.manifest(raw), "ok"

    return _each(files, work)


def verify(files: DataFrame, quick: bool = False) -> DataFrame:
    def work(path: str):
        raw = read_bytes(path)
        m = fmt.verify(raw, quick)
        return None, m["original"]["len"], len(raw), m, "ok (quick)" if quick else "ok (full)"

    return _each(files, work)


def restore(files: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    def work(path: str):
        raw = read_bytes(path)
        data, m = fmt.unpack(raw), fmt.manifest(raw)
        target = f"{folder}/{m['original']['name'] or path.rpartition('/')[2] + '.restored'}"
        write_bytes(target, data, overwrite)
        return target, len(data), len(raw), m, "ok"

    return _each(files, work)


def repair(files: DataFrame, apply: bool = False) -> DataFrame:
    """Status clean, no parity, repairable, repaired, or FAILED where a stripe has too many bad shards.

    Where a file system can write into a file, repairing writes the patches alone, else the whole
    archive under a temporary name. `original` is how many shards were bad.
    """
    def work(path: str):
        raw = read_bytes(path)
        if not fmt.footer(raw).parity:
            return None, 0, len(raw), None, "no parity"
        found = fmt.scan(raw)
        if found and not all(x[3] for x in found):
            raise fmt.ArchiveError("unrepairable", f"{len(found)} damaged stripes")
        if found and apply:
            fs, at = open_fs(path)
            if isinstance(fs, pafs.LocalFileSystem):
                with open(at, "r+b") as f:
                    for place, right in fmt.patches(raw):
                        f.seek(place)
                        f.write(right)
            else:
                write_bytes(path, fmt.repair(raw), overwrite=True)
        return None, sum(a + b for _, a, b, _ in found), len(raw), None, ("repaired" if apply else "repairable") if found else "clean"

    return _each(files, work)


_PREVIEW = "path string, width int, height int, png binary, status string, error_code string, error_detail string"


def _picture(raw: bytes) -> tuple[tiff.Segment, bytes, int, bytes]:
    """(segment, its bytes, orientation, the file with zeros for pixels) of the smallest image of three samples."""
    kept = fmt.is_archive(raw)
    bare = fmt.skeleton(raw) if kept else raw
    _, turn, found = tiff.layout(io.BytesIO(bare))
    own = min((s for s in found if s.spec and s.spec.samples == 3), key=lambda s: s.len, default=None)
    if own is None:
        raise fmt.ArchiveError("preview", "no image of three samples")
    pixels = fmt.unpack(raw) if kept else raw
    return own, pixels[own.offset : own.offset + own.len], turn, bare


def _colour(bare: bytes) -> tuple[str, bool]:
    """(transfer curve, whether primaries are BT.2020) by the file's colour profile."""
    _, found = tiff.directories(tiff.window(io.BytesIO(bare)))
    data = next((e.data for d in found for e in d.entries if e.tag == 34675 and e.data is not None), None)
    try:
        p = icc.parse(data or b"")
    except ValueError:
        return "srgb", False
    return p["curve"], p["bt2020"]


def _png(own: tiff.Segment, data: bytes, turn: int, bare: bytes, edge: int) -> bytes:
    s = own.spec
    pixels = np.frombuffer(data, f"{'<' if s.le else '>'}u{s.bits // 8}").reshape(s.height, s.width, 3)
    return images.preview(pixels, turn, edge, *_colour(bare))


def stored_previews(files: DataFrame) -> DataFrame:
    """(path, preview) of archives: the bytes that each begins with, without reading the rest; null where it has none."""
    @F.pandas_udf(T.BinaryType())
    def of(col: pd.Series) -> pd.Series:
        def one(path):
            try:
                fs, at = open_fs(path)
                with fs.open_input_file(at) as f:
                    return fmt.preview_of(f) or None
            except (fmt.ArchiveError, OSError):
                return None

        return col.map(one)

    return files.select("path", of(F.col("path")).alias("preview"))


def checksums(files: DataFrame) -> DataFrame:
    """(path, length, digest) of files that are read chunk by chunk."""
    @F.pandas_udf(T.StructType([T.StructField("length", T.LongType()), T.StructField("digest", T.StringType())]))
    def of(col: pd.Series) -> pd.DataFrame:
        def one(path):
            try:
                fs, at = open_fs(path)
                with fs.open_input_stream(at, compression=None) as f:
                    return copied(f)
            except OSError:
                return None, None

        return pd.DataFrame([one(p) for p in col], columns=["length", "digest"], index=col.index)

    return files.select("path", of(F.col("path")).alias("x")).select("path", "x.length", "x.digest")


def previews(files: DataFrame, edge: int = 512) -> DataFrame:
    """An upright PNG of each file's, or archive's, smallest image of three samples."""
    names = [x.split()[0] for x in _PREVIEW.split(", ")]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    own, data, turn, bare = _picture(read_bytes(path))
                    png = _png(own, data, turn, bare, edge)
                    row = (path, *struct.unpack(">II", png[16:24]), png, "ok", None, None)
                except fmt.ArchiveError as why:
                    row = (path, None, None, None, "FAILED", why.code, why.detail)
                except (ValueError, OSError) as why:
                    row = (path, None, None, None, "FAILED", "io", str(why))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return files.select("path").mapInArrow(run, _PREVIEW)


def exported(made: DataFrame, folder: str) -> DataFrame:
    """Writes previews() as PNG files to folder: path, target, width, height, status and reason of each."""
    names = ["path", "target", "width", "height", "status", "error_code", "error_detail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            targets = []
            for path, png in zip(b.column("path").to_pylist(), b.column("png").to_pylist(), strict=True):
                targets.append(None if png is None else f"{folder}/{path.rpartition('/')[2]}.png")
                if png is not None:
                    write_bytes(targets[-1], png, overwrite=True)
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(targets, pa.string()), *(b.column(n) for n in names[2:])], names)

    return made.mapInArrow(run, "path string, target string, width int, height int, status string, error_code string, error_detail string")


MANIFEST = "struct<version:bigint,container:string,orientation:int,original:struct<name:string,len:bigint,sha256:string>,body:struct<len:bigint,sha256:string>,segments:array<struct<offset:bigint,len:bigint,codec:string,parts:array<bigint>,spec:struct<width:bigint,height:bigint,bits:int,samples:int,layout:string,le:boolean>>>,provenance:struct<software:string,codec:string,made:string>,parity:struct<data:int,parity:int,shard:int>>"


def manifests(files: DataFrame) -> DataFrame:
    """path, manifest of every archive; null where a file has no intact one."""
    @F.pandas_udf(T.StringType())
    def text(col: pd.Series) -> pd.Series:
        def one(path):
            try:
                return json.dumps(fmt.manifest(read_bytes(path)))
            except (fmt.ArchiveError, OSError):
                return None

        return col.map(one)

    return files.select("path", F.from_json(text(F.col("path")), MANIFEST).alias("manifest"))
