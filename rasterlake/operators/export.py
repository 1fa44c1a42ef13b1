"""Rows as JSON: metadata by file and directory, and one line for each archive that a job made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats

#: Longest list of values that is written out; longer ones are left out, never cut.
MOST_RAW = 64


def capped(values: Column, most: int = MOST_RAW) -> Column:
    """An array as JSON, null where it has more elements than most."""
    return F.when(F.size(values) <= most, F.to_json(values))


def raw_value(value: Column, most: int = MOST_RAW) -> Column:
    """A value's exact numbers as JSON; null for texts, bytes and long lists."""
    fractions = F.transform(value["rats"], lambda r: F.array(r["n"], r["d"]))
    return F.when(value["tag"] == "rats", capped(fractions, most)).when(value["tag"] == "ints", capped(value["ints"], most)).when(value["tag"] == "reals", capped(value["reals"], most))


def _joined(rows: str, item: str) -> Column:
    """The items of collected structs (order first), in that order, as a list in JSON."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.col(rows)), lambda x: x[item]), ","), F.lit("]"))


def metadata_json(fields: DataFrame, most: int = MOST_RAW) -> DataFrame:
    """(path, json): each file's directories and their tags, with the file's own numbers beside what is shown.

    Two aggregates, by directory and by file; a file has 64 directories of 4096 entries at most.
    """
    own = F.to_json(F.struct(F.col("tag").alias("id"), F.col("name"), formats.type_name(F.col("dtype")).alias("type"), F.col("count"), F.col("value_offset").alias("offset"), F.coalesce("display", F.lit("")).alias("value")), {"ignoreNullFields": "false"})
    raw = F.when(~F.col("redacted"), raw_value(F.col("value"), most))
    extra = F.concat(F.coalesce(F.concat(F.lit(',"raw":'), raw), F.lit("")), F.when(F.col("redacted"), F.lit(',"redacted":true')).otherwise(F.lit("")))
    item = F.concat(F.substring(own, F.lit(1), F.length(own) - 1), extra, F.lit("}"))
    tags = fields.select("path", "container", "little_endian", "ifd_ord", "label", "ifd_offset", F.struct("ent_ord", item.alias("item")).alias("row"))
    found = tags.groupBy("path", "container", "little_endian", "ifd_ord", "label", "ifd_offset").agg(F.collect_list("row").alias("rows"))
    head = F.to_json(F.struct(F.col("label").alias("kind"), F.col("ifd_offset").alias("offset")))
    found = found.select("path", "container", "little_endian", F.struct("ifd_ord", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"tags":'), _joined("rows", "item"), F.lit("}")).alias("item")).alias("row"))
    found = found.groupBy("path", "container", "little_endian").agg(F.collect_list("row").alias("rows"))
    head = F.to_json(F.struct(F.col("path").alias("file"), "container", "little_endian"))
    return found.select("path", F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"directories":'), _joined("rows", "item"), F.lit("}")).alias("json"))


def result_lines(results: DataFrame) -> DataFrame:
    """(path, json): one line for each row of a job's results, with its ratio."""
    ratio = F.when(F.col("original") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("stored").cast("double"), F.col("original").cast("double")))
    return results.select("path", F.to_json(F.struct(F.col("path").alias("file"), F.col("target"), F.col("original").alias("original_len"), F.col("stored").alias("stored_len"), "payload_len", "skeleton_len", ratio.alias("ratio"), "sha256", "status", "error_code", (F.col("seconds") * 1000).alias("ms_total"), "peak_rss")).alias("json"))
