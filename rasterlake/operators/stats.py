"""Measures of runs: high-water marks, which step raised them, and what a query counts on its way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def peaks(steps: DataFrame, key: str, value: str, *, any_of: dict[str, Column] | None = None, all_of: dict[str, Column] | None = None) -> DataFrame:
    """(key, peak, total, flags): the highest value and the sum of each key's steps, with partial results in every task."""
    flags = [F.bool_or(c).alias(n) for n, c in (any_of or {}).items()] + [F.bool_and(c).alias(n) for n, c in (all_of or {}).items()]
    return steps.groupBy(key).agg(F.max(value).alias("peak"), F.sum(value).alias("total"), *flags)


def raised(steps: DataFrame, key: str, order: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """steps with `raised`: whether a step goes above all before it. Marks never go down, so only such a step explains a peak."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("raised", F.col(value) > F.coalesce(F.max(value).over(before), F.lit(floor)))


def observed(df: DataFrame, name: str, value: str) -> tuple[DataFrame, Observation]:
    """df, and what it counts when it runs: rows, sum and highest value, without a job of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"), F.max(value).alias("peak")), seen


def peak_rss() -> int:
    """The most bytes of memory that this process has held."""
    import resource
    import sys

    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * (1 if sys.platform == "darwin" else 1024)
