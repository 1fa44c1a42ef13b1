"""python -m rasterlake archive|verify|restore|repair|layout|exif|thumb [options] FILE..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archive import jobs
from .archive.format import Parity
from .functions import formats
from .operators import export, facets, layout, tags
from .sources import icc, images

#: Share of their size that pixels take in a dry run's estimate.
PLANNED_SHARE = 0.55
_ICC = 34675


def profiles(entries: DataFrame) -> DataFrame:
    """(path, profile) of the files that have a colour profile."""
    return entries.where(f"tag = {_ICC} and bytes is not null").groupBy("path").agg(F.min_by("bytes", F.struct(*facets.ORDER)).alias("raw")).select("path", icc.profile(F.col("raw")).alias("profile"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="rasterlake", description=__doc__)
    p.add_argument("what", choices=("archive", "verify", "restore", "repair", "layout", "exif", "thumb"))
    p.add_argument("files", nargs="+")
    p.add_argument("--out", default=".", help="folder of what is written")
    p.add_argument("--codec", default="zlib")
    p.add_argument("--parity", type=int, default=0, help="percent of parity")
    p.add_argument("--edge", type=int, default=512, help="longest side of a preview")
    p.add_argument("--places", help="Parquet table of city, country, lat, lon, population")
    for flag, text in (("quick", "check stored bytes alone"), ("apply", "repair, not only tell"), ("dry-run", "tell what archives would hold"), ("all", "unnamed tags too"), ("redact", "hide what is private"), ("full", "all tags instead of a summary"), ("overwrite", ""), ("json", "lines of JSON"), ("stats", "time, memory and throughput")):
        p.add_argument(f"--{flag}", action="store_true", help=text)
    p.add_argument("--group", action="append", help="directories whose label begins so")
    p.add_argument("--tag", action="append", help="tags whose name holds this")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("rasterlake").getOrCreate()
    files = spark.createDataFrame([(f,) for f in a.files], "path string").repartition(len(a.files))
    shards = formats.parity_for_percent(a.parity)

    def exif() -> DataFrame:
        entries = images.image_entries(files)
        found = facets.fields(entries, everything=a.all, redact=a.redact, groups=a.group, names=a.tag)
        if a.json:
            return export.metadata_json(found)
        if a.full or a.all or a.group or a.tag:
            return found.select("path", "label", "name", "type_note", F.coalesce(F.array_join("matrix", "\n"), "display").alias("display")).orderBy("path")
        places = spark.read.parquet(a.places) if a.places else None
        rows = facets.facet_rows(found, places, profiles(entries))
        return rows.orderBy("path", "ord").select("path", "facet", F.array_join("parts", " · ").alias("tells"))

    def archive() -> DataFrame:
        if a.dry_run:
            return layout.planned(images.image_segments(files).where("status = 'ok'"), "path", PLANNED_SHARE)
        return told(jobs.archive(files, a.out, a.codec, Parity(parity=shards) if shards else None, a.edge))

    def told(results: DataFrame) -> DataFrame:
        if a.json:
            return export.result_lines(results)
        own = results.drop("seconds", "peak_rss")
        return own if not a.stats else results.withColumns({"throughput": formats.throughput(F.col("original"), F.col("seconds")), "memory": formats.human_bytes(F.col("peak_rss"))})

    def verify() -> DataFrame:
        names = jobs.manifests(files).select(F.col("path").alias("__path"), F.col("manifest.original.name").alias("__name"))
        derived = jobs.derived_names(F.col("__name"))
        out = told(jobs.verify(files, a.quick))
        return out if a.json else out.join(names, F.col("path") == F.col("__path"), "left").withColumn("holds", formats.holds(F.col("__name"), derived, F.substring_index("path", "/", -1))).drop("__path", "__name")

    def thumb() -> DataFrame:
        made = jobs.previews(files, a.edge)
        return jobs.exported(made, a.out)

    def clear(df: DataFrame) -> bool:
        return not ("status" in df.columns and df.where("status = 'FAILED'").limit(1).count())

    out = {
        "archive": archive, "verify": verify, "restore": lambda: told(jobs.restore(files, a.out, a.overwrite)), "repair": lambda: told(jobs.repair(files, a.apply)),
        "layout": lambda: images.image_segments(files), "exif": exif, "thumb": thumb,
    }[a.what]().cache()
    if a.json:
        for row in out.select("json").toLocalIterator():
            print(row.json)
    else:
        out.show(out.count(), truncate=False)
        if a.what in ("archive", "restore") and "original" in out.columns:
            layout.totals(out.withColumn("codec", F.lit(a.codec)), "codec", "original", "stored").show()
    if a.what == "exif" and a.all and not a.json:
        tags.field_counts(facets.fields(images.image_entries(files), everything=True)).show()
    return int(not clear(out))


if __name__ == "__main__":
    sys.exit(main())
