"""Operator 6: mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources share the total by weight; a source's target stops at `epochs` times its size, and what
it can't take goes to the others by weight. That is one level L with target = min(cap, L * weight),
found by sorting sources by cap / weight. Every document is taken floor(target / size) whole times;
documents whose seeded hash is at most the source's cut are taken once more. The cut is the one at
which the source comes nearest to its target from its documents in hash order, so a source misses
its target by half a document at most (rows that share a doc_id stand or fall together).

Only tables of one row a source, and a source's 4096 hash buckets, are ever sorted; the cut is
looked for in one bucket. Null sources are a source of their own, the last; null texts have size 0;
texts of any length count whole; a source of size 0 takes nothing; sources that fill at one level go
by name, documents by hash, and repeated rows share a hash; an empty table gives an empty table.
mixture() reads doc_id, source and text alone; mixed() keeps all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_words_of, text_of, with_small, written

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 17
_HEX = 3


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row a source: source, source_size, target, whole, cut. sizes: source, size, key."""
    c = F.col
    buckets = written(sizes.groupBy("source", F.substring("key", 1, _HEX).alias("bucket")).agg(F.sum("size").alias("size")), "mix-buckets")
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)
    s = buckets.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    s = s.withColumn("cap", (epochs * c("source_size")).cast("double")).withColumn("fills_at", c("cap") / c("weight"))
    order = Window.orderBy("fills_at", F.asc_nulls_last("source"))
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("weight").over(rest))
    # The level that holds is that of the first source, in this order, that it doesn't fill.
    s = s.withColumn("level", F.min(F.when(c("fills_at") >= c("level"), F.struct("fills_at", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least("cap", c("level") * c("weight")))
    s = s.withColumn("whole", F.when(c("source_size") > 0, F.floor(c("target") / c("source_size"))).otherwise(0).cast("long"))
    s = s.withColumn("more", c("target") - c("whole") * c("source_size")).select("source", "source_size", "target", "whole", "more")
    s = written(s, "mix-sources")
    at = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    b = with_small(buckets.withColumn("before", F.coalesce(F.sum("size").over(at), F.lit(0))), s.select("source", "more"), "source")
    b = b.where(c("before") + c("size") > c("more")).groupBy("source").agg(F.min(F.struct("bucket", "before")).alias("at"))
    s = with_small(s, b, "source")
    k = with_small(sizes, s.select("source", "more", "at"), "source").where(F.substring("key", 1, _HEX) == c("at.bucket"))
    k = k.groupBy("source", "key").agg(F.sum("size").alias("size"), F.first("more").alias("more"), F.first("at.before").alias("start"))
    in_bucket = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    k = k.withColumn("before", c("start") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    k = k.where(c("before") + c("size") / 2 <= c("more")).groupBy("source").agg(F.max("key").alias("last"))
    # Without a bucket in which the target is passed, all are taken; without a key, those of the buckets before.
    s = with_small(s, k, "source").withColumn("cut", F.when(c("at").isNull(), F.lit("g")).otherwise(F.coalesce(c("last"), c("at.bucket"))))
    return written(s.select("source", "source_size", "target", "whole", "cut"), "mix-plan")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words_of(text_of()).alias("size"), _key(seed).alias("key"))


def mixture(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    sizes = written(sized(docs, seed), "mix-sizes")
    out = with_small(sizes, plan(sizes, weights, epochs), "source")
    out = out.withColumn("copies", F.col("whole") + (F.col("key") <= F.col("cut")).cast("long"))
    out = out.withColumn("copies", F.least("copies", F.lit(epochs).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The documents, each as many times as the mix takes it, with their own columns."""
    names = docs.columns
    made = plan(written(sized(docs, seed), "mix-sizes"), weights, epochs)
    small = made.select(F.col("source").alias("__mix_source"), F.col("whole").alias("__mix_whole"), F.col("cut").alias("__mix_cut"))
    out = with_small(docs.withColumn("__mix_source", F.col("source").cast("string")), small, "__mix_source")
    copies = F.least(F.col("__mix_whole") + (_key(seed) <= F.col("__mix_cut")).cast("long"), F.lit(epochs).cast("long"))
    return out.withColumn("__mix_copy", F.explode(F.expr("sequence(1L, 3L)") if epochs == 3 else F.sequence(F.lit(1).cast("long"), F.lit(epochs).cast("long")))).where(F.col("__mix_copy") <= copies).select(*names)
