"""Metadata entries: dictionary joins, filters, redaction, and the first value of each name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dictionaries

REDACTED = "<redacted>"


def tag_dimension(spark: SparkSession) -> DataFrame:
    """ns, tag, name, kind: 231 rows."""
    return spark.createDataFrame(dictionaries.tag_rows(), "ns string, tag int, name string, kind string")


def enum_dimension(spark: SparkSession) -> DataFrame:
    """name, value, text: about a hundred rows."""
    return spark.createDataFrame(dictionaries.enum_rows(), "name string, value long, text string")


def namespace(ifd_kind: Column) -> Column:
    """Tag numbers mean something within a directory only."""
    return F.when(ifd_kind == "Gps", "gps").when(ifd_kind == "Interop", "interop").otherwise("tiff")


def with_names(entries: DataFrame) -> DataFrame:
    """entries (ifd_kind, tag) with name and kind; both null where the tag is unknown."""
    dim = tag_dimension(entries.sparkSession).withColumnRenamed("tag", "__tag")
    out = entries.drop("name", "kind").withColumn("__ns", namespace(F.col("ifd_kind")))
    return out.join(F.broadcast(dim), (F.col("__ns") == F.col("ns")) & (F.col("tag") == F.col("__tag")), "left").drop("ns", "__ns", "__tag")


def with_enum_text(fields: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """fields with shown: "text (n)", or the number where it has no text."""
    dim = enum_dimension(fields.sparkSession).toDF("__name", "__value", "__text")
    out = fields.join(F.broadcast(dim), (F.col(name) == F.col("__name")) & (F.col(value) == F.col("__value")), "left")
    number = F.col(value).cast("string")
    return out.withColumn("shown", F.when(F.col("__text").isNull(), number).otherwise(F.concat("__text", F.lit(" ("), number, F.lit(")")))).drop("__name", "__value", "__text")


def field_counts(fields: DataFrame, by: str = "label") -> DataFrame:
    """(by, field_count, unknown_count): entries of each directory, and how many have no name."""
    return fields.groupBy(by).agg(F.count(F.lit(1)).alias("field_count"), F.count_if(F.col("name").isNull()).alias("unknown_count"))


def in_groups(label: Column, groups: list[str]) -> Column:
    """Whether a directory's label begins with any of groups, in either case; all without groups."""
    return F.lit(True) if not groups else F.coalesce(_any(F.lower(label).startswith(g.lower()) for g in groups), F.lit(False))


def named(name: Column, parts: list[str]) -> Column:
    """Whether a name holds any of parts, in either case; unnamed never do; all without parts."""
    return F.lit(True) if not parts else F.coalesce(_any(F.lower(name).contains(p.lower()) for p in parts), F.lit(False))


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def selected(fields: DataFrame, *, everything: bool = False, groups: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """fields (label, name) that a reader asks for; unnamed ones only with everything."""
    keep = in_groups(F.col("label"), groups or []) & named(F.col("name"), tags or [])
    return fields.where(keep if everything else keep & F.col("name").isNotNull())


def redacted(fields: DataFrame, kind: Column, columns: list[str], shown: str) -> DataFrame:
    """fields with `shown` replaced and columns nulled where kind is Sensitive; no row goes."""
    hide = F.coalesce(kind == "Sensitive", F.lit(False))
    out = fields.withColumn(shown, F.when(hide, F.lit(REDACTED)).otherwise(F.col(shown)))
    return out.withColumns({c: F.when(~hide, F.col(c)) for c in columns})


def first_values(fields: DataFrame, key: str, name: str, value: str, order: list[str], names: list[str]) -> DataFrame:
    """(key, one column a name): the first value that is not empty, in the given order.

    One aggregate with partial results in every task; no sort.
    """
    filled = F.nullif(F.trim(F.col(value)), F.lit("")).isNotNull()
    return fields.groupBy(key).agg(*(F.min_by(F.trim(F.col(value)), F.when(filled & (F.col(name) == n), F.struct(*order))).alias(n) for n in names))
