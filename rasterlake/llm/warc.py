"""Operator 10: deterministic sharded WARC writer, and its reader.

Records are sorted by page_id within ranges. Cuts between ranges come from a sample by hash of
page_id and their number from the bytes, so the same rows give the same files on any cluster.
A task writes its range as gzip members, one a record, and starts a new file when one reaches
`roll_bytes` compressed. Files are written under temporary names and renamed when complete; a task
that is run again writes the same bytes to the same names. The manifest, written last, lists the
files with sizes and digests: what it doesn't list is not part of the archive.

Payloads of `least` bytes or more that occur again are revisit records, which refer to the record
with the smallest page_id by its record id, address and date; headers and digests are made anew from
the payloads, and checked with the payload's length when read. A file begins with a warcinfo record.
Null payloads are empty, null page_ids sort first and are only referred to by rows that are null too,
and among rows of one page_id and payload the first by url is the response. Payloads of any length are
one record. An empty table gives a manifest without files; other columns than page_id, url and html
are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 100
ROLL_BYTES = 256 << 20
RANGE_BYTES, LEAST_RANGES = 256 << 20, 32
DATE = "2020-01-01T00:00:00Z"
SOFTWARE = "rasterlake"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _record_id(page_id: int | None, url: str | None, digest: str, revisit: bool) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{url}/{digest}/{revisit}')}>"


def warcinfo(name: str) -> bytes:
    """The record that a file begins with."""
    block = f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None, str | None] | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header alone. refers_to: page_id and url of the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, url, digest, revisit)}", f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_one_line(url)}"] if url else []), f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *(["X-Page-ID: " + str(page_id)] if page_id is not None else []), *([f"X-Refers-To-Page-ID: {refers_to[0]}"] if revisit and refers_to[0] is not None else []),
        *([f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(*refers_to, digest, False)}", f"WARC-Refers-To-Date: {DATE}"] if revisit else []), *([f"WARC-Refers-To-Target-URI: {_one_line(refers_to[1])}"] if revisit and refers_to[1] else []), "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _one_line(url: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


class _Rolling:
    """Files of one range under temporary names; each is renamed when it is complete."""

    def __init__(self, uri: str, piece: int, roll_bytes: int) -> None:
        self.fs, self.dir = _fs(uri)
        self.piece, self.roll, self.seq, self.out, self.done = piece, roll_bytes, 0, None, []

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.dir}/_temporary-files/{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.dir}/_temporary-files", recursive=True)
            self.out, self.sha, self.size, self.records, self.first = self.fs.open_output_stream(self.temp), hashlib.sha256(), 0, 0, page_id
            self.name = f"pages-{self.piece:07d}-{self.seq:05d}.warc.gz"
            self._put(warcinfo(self.name))
        self._put(raw)
        self.records += 1
        self.last = page_id
        if self.size >= self.roll:
            self.close()

    def _put(self, raw: bytes) -> None:
        member = gzip.compress(raw, 6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.fs.move(self.temp, f"{self.dir}/{self.name}")
        self.done.append((self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last))
        self.out, self.seq = None, self.seq + 1


_FILES = "file string, records long, bytes long, sha256 string, first_page_id long, last_page_id long"


def _write(batches: Iterator[pa.RecordBatch], uri: str, roll_bytes: int) -> Iterator[pa.RecordBatch]:
    out, done, page, refs, seen = None, [], object(), {}, set()
    for b in batches:
        for piece, page_id, note, digest, first, url, html in zip(*(b.column(c).to_pylist() for c in ("piece", "page_id", "note", "digest", "first", "url", "html")), strict=True):
            if out is None or out.piece != piece:
                if out is not None:
                    out.close()
                    done += out.done
                out = _Rolling(uri, piece, roll_bytes)
            if page_id != page:
                page, refs, seen = page_id, {}, set()
            if note == 0:
                refs[digest] = (first, url)
                continue
            payload = html or b""
            digest = hashlib.sha256(payload).hexdigest()
            known = digest in refs
            revisit = known and (refs[digest][0] != page_id or digest in seen)
            seen.add(digest)
            out.add(page_id, record(page_id, url, payload, digest, refs.get(digest), revisit))
    if out is not None:
        out.close()
        done += out.done
    if done:
        cols = list(zip(*done, strict=True))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in _FILES.split(", ")])


def write_warc(pages: DataFrame, path: str, least: int = LEAST, roll_bytes: int = ROLL_BYTES) -> dict:
    """Writes page_id, url, html as an archive at path and returns its manifest.

    The manifest has a row a file: files are as large as roll_bytes and ranges allow, so that it
    stays small beside the pages.
    """
    spark = pages.sparkSession
    uri = qualified(spark, path)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    pages = pages.withColumn("digest", F.sha2("html", 256))
    n, size = pages.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("html")), F.lit(0))).first()
    ranges = max(LEAST_RANGES, size // RANGE_BYTES)
    every = max(1, n // (ranges * 20))
    ids = sorted(r[0] for r in pages.select("page_id").where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).distinct().collect())
    cuts = sorted({ids[i * len(ids) // ranges] for i in range(1, ranges)} if ids else set())

    @F.pandas_udf("int")
    def piece(col, null):
        import numpy as np
        import pandas as pd

        v = np.searchsorted(np.array(cuts, np.int64), col.fillna(0).astype("int64").to_numpy(), "right")
        return pd.Series(np.where(null, 0, v), index=col.index)

    long = pages.where(F.length("html") >= least).select("page_id", "digest", "url")
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url")))
    again = long.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first"), F.col("first.url").alias("url"))
    notes = long.drop("url").join(again, "digest").where("first is not null").select("page_id", "digest", "first", "url").distinct()
    rows = pages.select("page_id", F.lit(1).alias("note"), "digest", F.lit(None).cast("long").alias("first"), "url", "html").unionByName(notes.select("page_id", F.lit(0).alias("note"), "digest", "first", "url", F.lit(None).cast("binary").alias("html")))
    rows = rows.withColumn("piece", piece("page_id", F.col("page_id").isNull()))
    rows = rows.repartitionById(len(cuts) + 1, F.col("piece")).sortWithinPartitions("piece", "page_id", "note", "digest", "url")
    files = sorted(tuple(r) for r in rows.mapInArrow(lambda b: _write(b, uri, roll_bytes), _FILES).collect())
    manifest = {"format": "WARC/1.1", "files": [dict(zip((x.split()[0] for x in _FILES.split(", ")), f, strict=True)) for f in files]}
    fs, at = _fs(uri)
    fs.create_dir(at, recursive=True)
    temp = f"{at}/_manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(json.dumps(manifest, indent=1).encode())
    fs.move(temp, f"{at}/manifest.json")
    if fs.get_file_info(f"{at}/_temporary-files").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{at}/_temporary-files")  # what lost attempts left
    return manifest


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("the archive ends within a record")
        yield head, block


_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html binary"


def _read(batches: Iterator[pa.RecordBatch], uri: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    fs, at = _fs(uri)
    names = [x.split()[0] for x in _RECORDS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for b in batches:
        for name in b.column("file").to_pylist():
            rows, size = [], 0
            with fs.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for head, block in records(stream):
                    if head["warc-type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = head["warc-payload-digest"].removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != head["warc-block-digest"].removeprefix("sha256:") or (head["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"damaged record in {name}")
                    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if head["warc-type"] == "response" and length != len(payload):
                        raise ValueError(f"a payload of {len(payload)} bytes in {name} instead of {length}")
                    page, to = head.get("x-page-id"), head.get("x-refers-to-page-id")
                    rows.append((int(page) if page else None, length, digest, head["warc-type"], int(to) if to else None, head.get("warc-target-uri"), payload if payloads and head["warc-type"] == "response" else None))
                    size += len(block) if payloads else 100
                    if size > 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
            if rows:
                yield batch(rows)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; digests are checked on the way."""
    uri = qualified(spark, path)
    fs, at = _fs(uri)
    with fs.open_input_stream(f"{at}/manifest.json") as f:
        files = [(x["file"],) for x in json.loads(f.read())["files"]]
    listed = spark.createDataFrame(files, "file string")
    listed = listed.repartition(max(1, len(files))) if files else listed
    return listed.mapInArrow(lambda b: _read(b, uri, payloads), _RECORDS)
