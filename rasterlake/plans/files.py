"""Queries over files: images made from the driver's tables, read, archived, damaged, repaired and told of.

Suppliers stand for photographs (metadata alone; every fifth in a JPEG, every seventh no image),
nations for files with pixels (every third RGB, the others colour mosaics). Files are written by the
tasks to the folder in spark.checkpoint.dir, and go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..archive import format as fmt
from ..archive import jobs
from ..functions import dictionaries, formats
from ..operators import export, facets, integrity
from ..sources import build, icc, images
from ..streaming import ingest
from .catalogue import _values, c, lit, query, table


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rasterlake-"))
        at = spark.sparkContext.getCheckpointDir()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return fs.makeQualified(path).toString()


def written(rows: DataFrame, at: str, make) -> DataFrame:
    """path of a file for each row (k, text) of rows: what make(k, text) gives, under the name it gives."""
    def run(batches):
        for b in batches:
            paths = []
            for k, text in zip(b.column("k").to_pylist(), b.column("text").to_pylist(), strict=True):
                name, data = make(k, text)
                jobs.write_bytes(f"{at}/{name}", data, overwrite=True)
                paths.append(f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    # The files are there once the rows have been counted; later plans read their names alone.
    paths = rows.select("k", "text").mapInArrow(run, "path string")
    names = f"{at}-names"
    paths.write.parquet(names)
    return rows.sparkSession.read.schema("path string").parquet(names)


def photograph(k: int, name: str) -> tuple[str, bytes]:
    if k % 7 == 0:
        return f"{k}.txt", name.encode()
    t = build.Tiff("<" if k % 2 else ">")
    gps = t.directory([(1, 2, "S" if k % 3 else "N"), (2, 5, [(k % 90, 1), (k % 60, 1), (k * 25 % 6000, 100)]), (3, 2, "W" if k % 4 else "E"), (4, 5, [(k % 180, 1), (0, 1), (0, 1)])])
    exif = t.directory([(33434, 5, (1, k)), (33437, 5, (28 + k % 40, 10)), (34855, 3, 100 * (k % 8 + 1)), (36867, 2, f"2020:01:{k % 28 + 1:02d} 10:{k % 60:02d}:00"), (37386, 5, (k % 200 + 1, 2))])
    main = t.directory([(256, 4, 6000 + k), (257, 4, 4000), (258, 3, 8 if k % 2 else 16), (262, 3, 2), (271, 2, f"Maker {k % 9}"), (272, 2, name), (274, 3, k % 8 + 1), (315, 2, f"Artist {k}"), (50721, 10, [(1, 3)] * 9), (34665, 4, exif), (34853, 4, gps)])
    raw = t.done(main)
    return (f"{k}.jpg", build.jpeg(raw)) if k % 5 == 0 else (f"{k}.tif", raw)


def picture(k: int, name: str) -> tuple[str, bytes]:
    import numpy as np

    t = build.Tiff()
    w, h, samples, bits = (700, 500 + k, 3, 8) if k % 3 == 1 else (1024, 520 + 2 * k, 1, 16)
    ramp = np.add.outer(np.arange(h) * (k + 1), np.arange(w * samples) * 3) % 200
    at = t.put(ramp.astype(f"<u{bits // 8}").tobytes())
    size = w * h * samples * bits // 8
    main = t.directory([(256, 4, w), (257, 4, h), (258, 3, [bits] * samples), (259, 3, 1), (262, 3, 2 if samples == 3 else 32803), (272, 2, name), (273, 4, at), (274, 3, k % 8 + 1), (277, 3, samples), (279, 4, size)])
    return f"{k}.tif", t.done(main, b"the end")


def photographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("k"), c("s_name").alias("text")), folder(spark, "photographs"), photograph)


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("text")), folder(spark, "pictures"), picture)


def _k(path: str = "path"):
    """The number that a file is named by."""
    return F.regexp_extract(path, r"(\d+)(\.rla)?\.[a-z]+$", 1).cast("long").alias("k")


_TRIM = "rtrim(rtrim(printf('%.{0}f', {1}), '0'), '.')"
_TURNS = ", ".join(f"({v}, '{t} ({v})')" for n, v, t in dictionaries.enum_rows() if n == "Orientation")
_PHOTOS = f"""WITH p AS (SELECT s_suppkey AS k, s_name AS model FROM supplier WHERE s_suppkey % 7 <> 0), turns(v, txt) AS (VALUES {_TURNS}),
f AS (SELECT k, 'IFD0' AS label, 'Make' AS name, 'Maker ' || (k % 9) AS display FROM p UNION ALL SELECT k, 'IFD0', 'Model', model FROM p
 UNION ALL SELECT k, 'IFD0', 'ImageWidth', (6000 + k)::VARCHAR FROM p UNION ALL SELECT k, 'IFD0', 'Orientation', txt FROM p JOIN turns ON v = k % 8 + 1
 UNION ALL SELECT k, 'Exif', 'ExposureTime', CASE WHEN k = 1 THEN '1 s' ELSE '1/' || k || ' s' END FROM p UNION ALL SELECT k, 'Exif', 'FNumber', 'f/' || {_TRIM.format(4, "(28 + k % 40) / 10.0::DOUBLE")} FROM p
 UNION ALL SELECT k, 'Exif', 'ISOSpeedRatings', 'ISO ' || (100 * (k % 8 + 1)) FROM p UNION ALL SELECT k, 'Exif', 'FocalLength', {_TRIM.format(4, "(k % 200 + 1) / 2.0::DOUBLE")} || ' mm' FROM p
 UNION ALL SELECT k, 'Exif', 'DateTimeOriginal', printf('2020-01-%02dT10:%02d:00', k % 28 + 1, k % 60) FROM p UNION ALL SELECT k, 'GPS', 'GPSLatitudeRef', CASE WHEN k % 3 = 0 THEN 'N' ELSE 'S' END FROM p
 UNION ALL SELECT k, 'IFD0', 'ColorMatrix1', '1/3, 1/3, 1/3, 1/3, 1/3, 1/3, 1/3, 1/3 ⋯ (9 values)' FROM p)
"""
_NAMES = ("Make", "Model", "ImageWidth", "Orientation", "ExposureTime", "FNumber", "ISOSpeedRatings", "FocalLength", "DateTimeOriginal", "GPSLatitudeRef", "ColorMatrix1")


@query(_PHOTOS + "SELECT * FROM f")
def file_fields(spark, sf_dir):
    """TIFF and JPEG files in both byte orders: every directory, entry and value, as shown."""
    found = facets.fields(images.image_entries(photographs(spark, sf_dir)))
    return found.where(c("name").isin(*_NAMES)).select(_k(), "label", "name", "display")


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'FAILED' ELSE 'ok' END AS status, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN 'jpeg' ELSE 'tiff' END AS container, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 2 = 1 END AS little_endian, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 20 END AS entries FROM supplier")
def file_containers(spark, sf_dir):
    """Containers told by their first bytes; a file that is no image is a row with a status. By the data source."""
    images.register(spark)
    # The source takes its list of files as an option: these are as many as suppliers.
    import json

    paths = json.dumps([r.path for r in photographs(spark, sf_dir).toLocalIterator()])
    found = spark.read.format("image_entries").option("paths", paths).load()
    return found.groupBy(_k(), "status", "container", "little_endian").agg(F.count(lit(1)).alias("entries"))


@query("""WITH p AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0) SELECT k, 'SHORT[1]' AS type_note, 'ISOSpeedRatings' AS name, NULL AS rows FROM p UNION ALL SELECT k, 'SRATIONAL[9]', 'ColorMatrix1', ' 0.333333   0.333333   0.333333' FROM p""")
def file_notes(spark, sf_dir):
    """Types with their counts, and matrices as three rows."""
    found = facets.fields(images.image_entries(photographs(spark, sf_dir)), names=["ISOSpeedRatings", "ColorMatrix1"])
    return found.select(_k(), "type_note", "name", c("matrix")[2].alias("rows"))


@query("""WITH p AS (SELECT s_suppkey AS k, s_name AS model, s_suppkey % 90 + (s_suppkey % 60) / 60.0::DOUBLE + (s_suppkey * 25 % 6000) / 100.0::DOUBLE / 3600.0::DOUBLE AS lat FROM supplier WHERE s_suppkey % 7 <> 0),
f AS (SELECT k, 'Camera' AS facet, 'Maker ' || (k % 9) || ' ' || model AS parts FROM p
 UNION ALL SELECT k, 'Shutter', CASE WHEN k = 1 THEN '1 s' ELSE '1/' || k || ' s' END FROM p
 UNION ALL SELECT k, 'ISO', (100 * (k % 8 + 1))::VARCHAR FROM p
 UNION ALL SELECT k, 'Where', printf('%.4f° %s, %.4f° %s', lat, CASE WHEN k % 3 = 0 OR lat = 0 THEN 'N' ELSE 'S' END, (k % 180)::DOUBLE, CASE WHEN k % 4 = 0 OR k % 180 = 0 THEN 'E' ELSE 'W' END) FROM p
 UNION ALL SELECT k, 'Format', CASE WHEN k % 5 = 0 THEN 'JPEG' ELSE 'TIFF' END || ' · ' || CASE WHEN k % 2 = 1 THEN 'little-endian' ELSE 'big-endian' END FROM p
 UNION ALL SELECT k, 'Image', (6000 + k) || ' × 4000 · ' || printf('%.1f MP', (6000 + k) * 4000 / 1000000.0::DOUBLE) FROM p
 UNION ALL SELECT k, 'Depth', CASE WHEN k % 2 = 1 THEN '8' ELSE '16' END || '-bit integer · RGB' FROM p
 UNION ALL SELECT k, 'Dynamic', 'standard, 8-bit, display-referred' FROM p WHERE k % 2 = 1
 UNION ALL SELECT k, 'Colour', 'camera matrix present' FROM p UNION ALL SELECT k, 'Author', 'Artist ' || k FROM p
 UNION ALL SELECT k, 'Taken', strftime(make_timestamp(2020, 1, k % 28 + 1, 10, k % 60, 0.0), '%A ') || (k % 28 + 1) || ' January 2020, ' || printf('10:%02d', k % 60) FROM p)
SELECT * FROM f""")
def file_summary(spark, sf_dir):
    """What a summary tells of each file, facet by facet."""
    rows = facets.facet_rows(facets.fields(images.image_entries(photographs(spark, sf_dir))))
    told = ("Camera", "Shutter", "ISO", "Where", "Format", "Image", "Depth", "Dynamic", "Colour", "Author", "Taken")
    return rows.where(c("facet").isin(*told)).select(_k(), "facet", F.array_join("parts", " · ").alias("parts"))


@query("SELECT s_suppkey AS k, 'Author' AS facet, '<redacted>' AS parts FROM supplier WHERE s_suppkey % 7 <> 0 UNION ALL SELECT s_suppkey, 'Where', '<redacted>' FROM supplier WHERE s_suppkey % 7 <> 0")
def file_summary_redacted(spark, sf_dir):
    """Sensitive facets of a summary of redacted fields."""
    rows = facets.facet_rows(facets.fields(images.image_entries(photographs(spark, sf_dir)), redact=True))
    return rows.where("sensitive").select(_k(), "facet", F.array_join("parts", " · ").alias("parts"))


_JSON = "struct<file:string,directories:array<struct<kind:string,offset:bigint,tags:array<struct<id:bigint,name:string,type:string,count:bigint,value:string,raw:string,redacted:boolean>>>>>"


@query("""WITH p AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT k, 'Exif' AS kind, 33434 AS id, 'RATIONAL' AS type, 1 AS count, '[[1,' || k || ']]' AS raw, NULL AS redacted FROM p
UNION ALL SELECT k, 'Exif', 34855, 'SHORT', 1, '[' || (100 * (k % 8 + 1)) || ']', NULL FROM p
UNION ALL SELECT k, 'IFD0', 315, 'ASCII', length('Artist ' || k) + 1, NULL, true FROM p
UNION ALL SELECT k, 'IFD0', 272, 'ASCII', 19, NULL, NULL FROM p""")
def file_json(spark, sf_dir):
    """Metadata as JSON, read again: exact numbers beside what is shown, none of redacted tags."""
    made = export.metadata_json(facets.fields(images.image_entries(photographs(spark, sf_dir)), redact=True))
    read = made.select(_k(), F.explode(F.from_json("json", _JSON)["directories"]).alias("d")).select("k", c("d.kind").alias("kind"), F.explode("d.tags").alias("t"))
    return read.where(c("t.id").isin(33434, 34855, 315, 272)).select("k", "kind", "t.id", "t.type", "t.count", "t.raw", "t.redacted")


_SIZE = "CASE WHEN n_nationkey % 3 = 1 THEN 700 * (500 + n_nationkey) * 3 ELSE 1024 * (520 + 2 * n_nationkey) * 2 END"


@query(f"""WITH p AS (SELECT n_nationkey AS k, {_SIZE} AS size FROM nation)
SELECT k, 0 AS seg_no, 'verbatim' AS kind, 0 AS src_offset, 8 AS len, NULL AS layout, k % 8 + 1 AS orientation FROM p
UNION ALL SELECT k, 1, 'image', 8, size, CASE WHEN k % 3 = 1 THEN 'chunky' ELSE 'cfa' END, k % 8 + 1 FROM p
UNION ALL SELECT k, 2, 'verbatim', 8 + size, NULL, NULL, k % 8 + 1 FROM p""")
def file_segments(spark, sf_dir):
    """Gapless layouts of image files."""
    s = images.image_segments(pictures(spark, sf_dir))
    return s.select(_k(), "seg_no", "kind", "src_offset", F.when(c("seg_no") < 2, c("len")).alias("len"), c("spec.layout").alias("layout"), "orientation")


@query(f"""SELECT n_nationkey AS k, {_SIZE} AS payload_len, 'ok' AS archived, 'ok (full)' AS full_check, 'ok (quick)' AS quick_check, 'FAILED' AS damaged, 'repairable' AS found, 'repaired' AS repaired, 'ok (full)' AS after, 'ok' AS restored, true AS same, n_nationkey % 3 = 1 AS preview, 'zlib' AS codec, n_nationkey || '.tif' AS name FROM nation""")
def file_archives(spark, sf_dir):
    """Files are archived with parity and a preview, checked, damaged, repaired and given back, all by the jobs."""
    originals = pictures(spark, sf_dir)
    at = folder(spark, "archives")

    def step(df: DataFrame) -> DataFrame:
        # Each step of the chain has effects on files, and so runs once.
        out = f"{at}/_steps/{uuid.uuid4().hex}"
        df.write.parquet(out)
        return spark.read.schema(df.schema).parquet(out)

    def status(df: DataFrame, name: str) -> DataFrame:
        return step(df).select(_k(), c("status").alias(name))

    def hurt(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                raw = bytearray(jobs.read_bytes(path))
                raw[fmt.footer(bytes(raw)).preview + len(fmt.MAGIC) + 5] ^= 0xFF
                jobs.write_bytes(path, bytes(raw), overwrite=True)
            yield b

    made = step(jobs.archive(originals, at, parity=fmt.Parity(8, 2, 4096), edge=64))
    kept = made.select(c("target").alias("path"))
    out = made.select(_k(), "payload_len", c("status").alias("archived"))
    told = step(jobs.manifests(kept)).select(_k(), c("manifest.provenance.codec").alias("codec"), c("manifest.original.name").alias("name"))
    shown = step(jobs.stored_previews(kept)).select(_k(), (F.substring("preview", 1, 4) == lit(b"\x89PNG")).alias("preview")).fillna(False)
    checks = [status(jobs.verify(kept), "full_check"), status(jobs.verify(kept, quick=True), "quick_check")]
    step(kept.mapInArrow(hurt, "path string"))
    checks += [status(jobs.verify(kept), "damaged"), status(jobs.repair(kept), "found"), status(jobs.repair(kept, apply=True), "repaired"), status(jobs.verify(kept), "after")]
    back = step(jobs.restore(kept, f"{at}/back"))
    checks.append(back.select(_k(), c("status").alias("restored")))
    before, after = (jobs.checksums(p).select(_k(), "length", "digest") for p in (originals, back.select(c("target").alias("path"))))
    same = step(before.join(after.toDF("k", "l", "d"), "k").select("k", ((c("length") == c("l")) & (c("digest") == c("d"))).alias("same")))
    for other in (told, shown, same, *checks):
        out = out.join(other, "k")
    return out


@query(f"SELECT n_nationkey AS k, 'ok' AS status, {_SIZE} AS payload_len, true AS smaller, true AS timed FROM nation")
def file_results(spark, sf_dir):
    """A job's results as lines of JSON, read again."""
    made = jobs.archive(pictures(spark, sf_dir), folder(spark, "archives"), edge=0)
    lines = export.result_lines(made).select(F.from_json("json", "file string, stored_len long, original_len long, payload_len long, ratio double, ms_total double, peak_rss long, status string").alias("r"))
    return lines.select(_k("r.file"), "r.status", "r.payload_len", (c("r.ratio") < 0.9).alias("smaller"), ((c("r.ms_total") > 0) & (c("r.peak_rss") > 1_000_000)).alias("timed"))


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 8 >= 4 THEN greatest(h, 1) ELSE w END AS width, CASE WHEN n_nationkey % 8 >= 4 THEN w ELSE h END AS height
FROM (SELECT n_nationkey, 64 AS w, floor(64.0::DOUBLE / 700 * (500 + n_nationkey) + 0.5::DOUBLE)::INT AS h FROM nation WHERE n_nationkey % 3 = 1)""")
def file_previews(spark, sf_dir):
    """Upright previews of the files with three samples, by their sides."""
    return jobs.previews(pictures(spark, sf_dir), 64).where("status = 'ok'").select(_k(), "width", "height")


@query("""SELECT r_regionkey AS k, r_name || '/' || n_name AS path, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS n FROM region JOIN nation ON n_regionkey = r_regionkey""")
def directory_walk(spark, sf_dir):
    """A file for each region: its nations are sub-directories, walked breadth first, each once though two point to it."""
    names = table(spark, sf_dir, "nation").groupBy(c("n_regionkey").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]), "\n").alias("names"))
    regions = table(spark, sf_dir, "region").join(names, c("r_regionkey") == c("r")).select(c("r_regionkey").cast("long").alias("k"), F.concat_ws("\n", "r_name", "names").alias("text"))

    def make(k: int, text: str) -> tuple[str, bytes]:
        region, *nations = text.split("\n")
        t = build.Tiff(">")
        subs = [t.directory([(270, 2, n)]) for n in nations]
        return f"{k}.tif", t.done(t.directory([(270, 2, region), (330, 4, [*subs, subs[0]])]))

    e = images.image_entries(written(regions, folder(spark, "regions"), make)).where("tag = 270")
    main = e.where("ifd_kind = 'Main'").select("path", c("value.text").alias("region"))
    return e.where("ifd_kind = 'Sub'").join(main, "path").select(_k(), F.concat_ws("/", "region", "value.text").alias("path"), c("ifd_n").cast("long").alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'version' WHEN 2 THEN 'manifest' ELSE 'footer' END AS status FROM orders""")
def version_gate(spark, sf_dir):
    """Archives of each order's comment on what reading them gives: right, of a later version, or damaged."""
    def run(batches):
        import hashlib
        import json

        for b in batches:
            out = []
            for k in b.column("o_orderkey").to_pylist():
                raw = fmt.pack(str(k).encode(), "x", "identity", made="")
                f = fmt.footer(raw)
                at = f.preview + len(fmt.MAGIC) + f.body
                if k % 4 == 1:  # a manifest of the version after this, with the right digest
                    text = json.dumps(fmt.manifest(raw) | {"version": fmt.VERSION + 1}).encode()
                    raw = raw[:at] + text * fmt.COPIES + fmt.Footer(f.preview, f.body, len(text), 0, hashlib.sha256(text).digest()[:8]).packed() * fmt.COPIES
                elif k % 4 == 2:
                    raw = raw[:at] + bytes(f.manifest * fmt.COPIES) + raw[at + f.manifest * fmt.COPIES :]
                elif k % 4 == 3:
                    raw = raw[:-4]
                try:
                    fmt.manifest(raw)
                    out.append("ok")
                except fmt.ArchiveError as why:
                    out.append(why.code)
            yield pa.RecordBatch.from_arrays([b.column("o_orderkey"), pa.array(out, pa.string())], ["o_orderkey", "status"])

    return table(spark, sf_dir, "orders").select("o_orderkey").mapInArrow(run, "o_orderkey long, status string")


@query("SELECT n_nationkey AS k, strlen(n_name) AS length, sha256(n_name) AS digest, n_nationkey % 5 = 0 AS changed FROM nation")
def stream_ingest(spark, sf_dir):
    """New files as a stream that is read once, and files that have changed since."""
    at, done = folder(spark, "arrivals"), folder(spark, "ingested")
    rows = table(spark, sf_dir, "nation").select(c("n_nationkey").cast("long").alias("k"), c("n_name").alias("text"))
    written(rows, at, lambda k, text: (f"{k}.txt", text.encode()))
    ingest.catalogue(ingest.new_files(spark, at), f"{done}/table", f"{done}/checkpoint").awaitTermination()
    known = spark.read.schema("path string, modificationTime timestamp, length bigint, digest string").parquet(f"{done}/table")
    now = known.withColumn("digest", F.when(_k() % 5 == 0, lit("another")).otherwise(c("digest")))
    changed = ingest.changed(now, known).select(c("path").alias("p"))
    return known.join(changed, c("path") == c("p"), "left").select(_k(), "length", "digest", c("p").isNotNull().alias("changed"))


_CODES = f"""primaries(pv, pn) AS (VALUES {_values(icc.PRIMARIES.items())}), curves(tv, tn) AS (VALUES {_values(icc.TRANSFER.items())})"""


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % 13 AS a, p_partkey % 19 AS b, p_partkey % 4 AS how FROM part), {_CODES},
d AS (SELECT k, how, CASE WHEN how = 0 THEN NULL WHEN how = 1 THEN 'Rec. 2100 PQ' WHEN how = 2 THEN 'sRGB' ELSE 'Display' END AS description, CASE WHEN how IN (0, 3) THEN coalesce(pn, 'unknown primaries') END AS primaries,
 CASE WHEN how IN (0, 3) THEN coalesce(tn, 'unknown transfer') END AS transfer, CASE WHEN how IN (0, 3) THEN b IN (16, 18) ELSE how = 1 END AS hdr FROM p LEFT JOIN primaries ON a = pv LEFT JOIN curves ON b = tv)
SELECT *, CASE WHEN hdr AND transfer IS NOT NULL THEN 'HDR, ' || transfer || ', ' || primaries WHEN hdr THEN 'HDR, ' || description ELSE 'standard, 8-bit, display-referred' END AS dynamic FROM d""")
def colour_profiles(spark, sf_dir):
    """Colour profiles of every kind, and the dynamic range that follows."""
    def run(batches):
        for b in batches:
            ks = b.column("p_partkey").to_pylist()
            names = (None, "Rec. 2100 PQ", "sRGB", "Display")
            raw = [build.colour_profile(*((k % 13, k % 19) if k % 4 in (0, 3) else (None, None)), names[k % 4]) for k in ks]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array(raw, pa.binary())], ["k", "raw"])

    made = table(spark, sf_dir, "part").select("p_partkey").mapInArrow(run, "k long, raw binary").withColumn("p", icc.profile(c("raw")))
    dynamic = formats.dynamic_range(lit(8), lit(1), lit(False), c("p"))
    return made.select("k", (c("k") % 4).alias("how"), "p.description", "p.primaries", "p.transfer", "p.hdr", dynamic.alias("dynamic"))


@query("""SELECT c_custkey, (c_custkey % 90) || '°' || (c_custkey % 60) || '''' || printf('%.2f', (c_custkey % 3599) / 100.0::DOUBLE) || '"' AS dms, printf('%.4f° ', abs(c_acctbal)) || CASE WHEN c_acctbal < 0 THEN 'W' ELSE 'E' END AS degrees FROM customer""")
def dms_text(spark, sf_dir):
    k = c("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", formats.dms_text(k % 90, k % 60, (k % 3599) / 100.0).alias("dms"), formats.degrees_text(c("c_acctbal"), "E", "W").alias("degrees"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderkey || '.tif' END AS holds, round(((o_orderkey % 7) + 1) * 100.0::DOUBLE / 32, 6) AS overhead FROM orders""")
def archive_names(spark, sf_dir):
    """An original's name where its archive's name does not tell it, and parity in percent."""
    k = c("o_orderkey")
    archive = F.when(k % 2 == 0, F.concat(k.cast("string"), lit(".rla.tif"))).otherwise(lit("other.rla.tif"))
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.holds(F.concat(k.cast("string"), lit(".tif")), F.concat(k.cast("string"), lit(".rla.tif")), archive).alias("holds"), F.round(formats.overhead_percent(k % 7 + 1, lit(32)), 6).alias("overhead"))


@query("""SELECT doc_id, strlen(text) AS original, sha256(text) AS digest, CASE WHEN doc_id % 3 = 0 THEN 'FAILED' ELSE 'ok (full)' END AS verdict FROM documents""")
def archive_verdicts(spark, sf_dir):
    """Archives of documents, every third with a byte changed: what comes back is judged by length and digest."""
    def run(batches):
        import hashlib

        for b in batches:
            rows = []
            for k, data in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                raw = bytearray(fmt.pack(data, str(k), "identity"))
                if k % 3 == 0:
                    raw[len(fmt.MAGIC)] ^= 1
                m = fmt.manifest(bytes(raw))
                body = bytes(raw)[len(fmt.MAGIC) : len(fmt.MAGIC) + m["body"]["len"]]
                rows.append((k, len(body), hashlib.sha256(body).hexdigest(), m["original"]["len"], m["original"]["sha256"]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "found_len", "found", "original", "digest"])

    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text").mapInArrow(run, "doc_id long, found_len long, found string, original long, digest string")
    return docs.select("doc_id", "original", "digest", integrity.verdict(c("found_len"), c("original"), c("found"), c("digest"), lit(False)).alias("verdict"))
