"""Layouts of objects: gapless segments, their checks, their sums and where they are stored.

All windows are partitioned by object, so an object's regions meet in one task and objects spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tile(regions: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, seg_no, src_offset, len, kind, status): the regions of each object and verbatim segments between.

    regions: key, src_offset, len. objects: key, total_len. Each region makes its own row, the gap
    before it and, the last one, the end of the object, so that both tables are read once and one
    shuffle by key serves join, windows and numbering. An object whose regions overlap or go past its
    end has one row, with that status and no segment.
    """
    key_only, by = Window.partitionBy(key), Window.partitionBy(key).orderBy("src_offset", "len")
    c = F.col
    r = objects.select(key, "total_len").join(regions.select(key, "src_offset", "len"), key, "left")
    r = r.withColumn("__end", c("src_offset") + c("len"))
    r = r.withColumn("__cursor", F.coalesce(F.max("__end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = r.withColumn("__last", F.lead(F.lit(1)).over(by).isNull()).withColumn("__overlap", F.coalesce(F.max((c("src_offset") < c("__cursor")).cast("int")).over(key_only), F.lit(0)) == 1)
    r = r.withColumn("status", F.when(c("__overlap"), "overlap").when(F.max("__end").over(key_only) > c("total_len"), "past the end").otherwise("ok"))
    piece = lambda at, n, kind: F.struct(at.cast("long").alias("src_offset"), n.cast("long").alias("len"), F.lit(kind).alias("kind"))
    none = F.lit(None).cast("struct<src_offset:bigint,len:bigint,kind:string>")
    reach = F.coalesce("__end", F.lit(0))
    parts = F.array(
        F.when(c("src_offset") > c("__cursor"), piece(c("__cursor"), c("src_offset") - c("__cursor"), "verbatim")),
        F.when(c("src_offset").isNotNull(), piece(c("src_offset"), c("len"), "image")),
        F.when(c("__last") & (c("total_len") > reach), piece(reach, c("total_len") - reach, "verbatim")),
    )
    whole = F.filter(parts, lambda x: x.isNotNull())
    bad = F.when(c("__last"), F.array(none)).otherwise(F.array().cast("array<struct<src_offset:bigint,len:bigint,kind:string>>"))
    out = r.select(key, "status", F.explode(F.when(c("status") == "ok", whole).otherwise(bad)).alias("s"))
    out = out.select(key, "s.src_offset", "s.len", "s.kind", "status")
    number = F.row_number().over(Window.partitionBy(key).orderBy("src_offset", "len")).cast("long") - 1
    return out.select(key, F.when(c("status") == "ok", number).alias("seg_no"), "src_offset", "len", "kind", "status")


def smallest(segments: DataFrame, key: str) -> DataFrame:
    """(key, seg_no, len) of each object's smallest image, the first of equal ones: what a preview is made from."""
    image = segments.where("kind = 'image'")
    return image.groupBy(key).agg(F.min_by("seg_no", F.struct("len", "seg_no")).alias("seg_no"), F.min("len").alias("len"))


def planned(segments: DataFrame, key: str, share: float) -> DataFrame:
    """(key, segments, payload_len, skeleton_len, stored): what an archive would hold, pixels at `share` of their size."""
    image = F.col("kind") == "image"
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("len"))), F.lit(0))
    p = segments.groupBy(key).agg(F.count(F.lit(1)).alias("segments"), n(image).alias("payload_len"), n(~image).alias("skeleton_len"))
    return p.withColumn("stored", (F.ceil(F.col("payload_len") * share) + F.col("skeleton_len")).cast("long"))


def validate(segments: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, n_segments, contiguous, overlaps, complete) of each object."""
    by = Window.partitionBy(key).orderBy("src_offset", "len")
    end = F.col("src_offset") + F.col("len")
    s = segments.select(key, "src_offset", "len").withColumn("before", F.coalesce(F.lag(end).over(by), F.lit(0)))
    s = s.withColumn("reach", F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), F.bool_and(F.col("src_offset") == F.col("before")).alias("contiguous"), F.sum((F.col("src_offset") < F.col("reach")).cast("long")).alias("overlaps"), F.max(end).alias("end"))
    out = objects.select(key, "total_len").join(s, key, "left")
    none = F.col("n_segments").isNull()
    return out.select(key, F.coalesce("n_segments", F.lit(0)).alias("n_segments"), F.coalesce("contiguous", F.lit(True)).alias("contiguous"), F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.when(none, F.col("total_len") == 0).otherwise(F.col("end") == F.col("total_len")).alias("complete"))


def payload(segments: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """(key, payload_len, skeleton_len): bytes of image segments, and all others."""
    p = segments.groupBy(key).agg(F.sum(F.when(F.col("kind") == "image", F.col("len")).otherwise(0)).alias("payload_len"))
    p = objects.select(key, "total_len").join(p, key, "left").withColumn("payload_len", F.coalesce("payload_len", F.lit(0)))
    return p.select(key, "payload_len", (F.col("total_len") - F.col("payload_len")).alias("skeleton_len"))


def ratio(stored: Column, original: Column) -> Column:
    """Stored bytes as a share of the original's; 1 for empty ones."""
    return F.when(original == 0, F.lit(1.0)).otherwise(F.try_divide(stored.cast("double"), original.cast("double")))


def totals(objects: DataFrame, by: str, original: str, stored: str) -> DataFrame:
    """A row a group and one over all (null) if there is more than one group."""
    out = objects.groupingSets([[F.col(by)], []], by).agg(F.count(F.lit(1)).alias("n_objects"), F.sum(original).alias("original"), F.sum(stored).alias("stored"), F.grouping(by).alias("is_total"), F.min(by).alias("__lo"), F.max(by).alias("__hi"))
    out = out.where("is_total = 0 or __lo <> __hi")
    return out.select(by, "n_objects", "original", "stored", F.col("is_total").cast("int").alias("is_total"), ratio(F.col("stored"), F.col("original")).alias("ratio"))


def run_offsets(runs: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """runs with start: what the runs before take in the same object."""
    by = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("start", F.coalesce(F.sum(size).over(by), F.lit(0)))
