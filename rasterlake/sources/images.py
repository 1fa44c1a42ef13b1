"""Image files as tables: entries, layouts and segments; a bad file is a row with a status.

image_entries() and image_segments() take a DataFrame of paths (of any size: files are opened in the
tasks and only the ranges that hold metadata are read). The data source `image_entries` offers the
same to spark.read, one partition for each group of files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import tiff

VALUE = "struct<tag:string,text:string,ints:array<bigint>,rats:array<struct<n:bigint,d:bigint>>,reals:array<double>,bin_len:bigint,why:string>"
ENTRIES = f"path string, container string, little_endian boolean, ifd_ord int, ifd_kind string, ifd_n int, label string, ifd_offset bigint, ent_ord int, tag int, dtype int, count bigint, value_offset bigint, inline boolean, bytes binary, value {VALUE}, status string, error_detail string"
SEGMENTS = "path string, container string, total_len bigint, orientation smallint, seg_no int, src_offset bigint, len bigint, kind string, spec struct<width:bigint,height:bigint,bits:int,samples:int,layout:string,le:boolean>, status string, error_detail string"
_BLANK = {"text": None, "ints": None, "rats": None, "reals": None, "bin_len": None, "why": None}


def _open(path: str):
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(at)


def entry_rows(path: str) -> Iterator[tuple]:
    try:
        with _open(path) as f:
            kept = is_archive_file(f)
            if kept:
                from ..archive import format as fmt

                f = fmt.Skeleton(f)
            w = tiff.window(f)
            mark, found = tiff.directories(w)
        container = f"{'archive of ' * kept}{'jpeg' if w.base else 'tiff'}"
        for i, d in enumerate(found):
            for j, e in enumerate(d.entries):
                yield (path, container, mark == "<", i, d.kind, d.n, d.label, d.offset, j, e.tag, e.dtype, e.count, e.value_offset, e.inline, e.data, _BLANK | tiff.value(mark, e), "ok", e.unreadable)
    except (ValueError, OSError) as why:
        yield (path, *[None] * 15, "FAILED", str(why))


def is_archive_file(f) -> bool:
    """Whether a file ends with an archive's footer, by its checksum, and has the mark where it says."""
    from ..archive import format as fmt

    size = tiff.size_of(f)
    f.seek(max(0, size - fmt.COPIES * fmt.FOOTER_SIZE))
    try:
        foot = fmt.footer(f.read(fmt.COPIES * fmt.FOOTER_SIZE), size)
    except fmt.ArchiveError:
        return False
    finally:
        f.seek(0)
    f.seek(foot.preview)
    mark = f.read(len(fmt.MAGIC))
    f.seek(0)
    return mark == fmt.MAGIC


def segment_rows(path: str) -> Iterator[tuple]:
    try:
        with _open(path) as f:
            total, turn, found = tiff.layout(f)
        for i, s in enumerate(found):
            spec = None if s.spec is None else {"width": s.spec.width, "height": s.spec.height, "bits": s.spec.bits, "samples": s.spec.samples, "layout": s.spec.layout, "le": s.spec.le}
            yield (path, "tiff", total, turn, i, s.offset, s.len, "image" if s.spec else "verbatim", spec, "ok", None)
    except (ValueError, OSError) as why:
        yield (path, *[None] * 8, "FAILED", str(why))


def _rows(files: DataFrame, make, schema: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = list(make(path))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path").mapInArrow(run, schema)


def image_entries(files: DataFrame) -> DataFrame:
    return _rows(files, entry_rows, ENTRIES)


def image_segments(files: DataFrame) -> DataFrame:
    return _rows(files, segment_rows, SEGMENTS)


def identified(files: DataFrame) -> DataFrame:
    """files of Spark's binaryFile source with container: by the first bytes alone."""
    head = F.hex(F.substring("content", 1, 4))
    return files.withColumn("container", F.when(head.isin("49492A00", "4D4D002A"), "tiff").when(head.startswith("FFD8"), "jpeg").otherwise("unknown"))


class _Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _EntryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        # Paths with commas are given one a line, or as a list in JSON.
        given = options["paths"]
        self.paths = json.loads(given) if given.startswith("[") else given.split("\n" if "\n" in given else ",")
        self.group = int(options.get("filesPerPartition", "64"))

    def partitions(self):
        return [_Files(self.paths[i : i + self.group]) for i in range(0, len(self.paths), self.group)]

    def read(self, partition):
        for path in partition.paths:
            yield from entry_rows(path)


class ImageEntries(DataSource):
    """spark.read.format("image_entries").option("paths", "a.tif,b.jpg").load(); paths may also be a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "image_entries"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _EntryReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ImageEntries)
