"""Operator 8: sharding by Hilbert-curve order, in DataFrame functions only.

Four metadata dimensions (source, lang, length, doc_id) are cut into 16 levels each: numbers at their
quantiles, strings by the share of rows with a lesser one, whole strings compared by code point. The
cell's index on the Hilbert curve orders the documents, and runs of that order are the shards.
Neighbours on the curve are neighbours in every dimension, so a shard spans a small box of metadata
and a filter on any dimension skips shards by their least and largest values.

Law `rows`: runs of equal counts, at most one apart. Law `bytes`: runs of near equal bytes, a
document going where its middle lies. Places come from counts by cell (at most 65,536) and by hash
bucket within a cell, so that no task sorts a hot cell; ties of a bucket go by doc_id, digest and
size. A null counts as below every value; null texts have size 1, long ones count whole; repeated
rows get places of their own; an empty table gives an empty table; columns shard and slot of the
input are replaced, others than the four dimensions and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ranked, text_of, with_small, written

BITS, SHARDS = 4, 8
LEVELS = 1 << BITS
#: Rows for each bucket of a cell.
BUCKET_ROWS = 100_000


def string_levels(df: DataFrame, name: str, levels: int = LEVELS) -> DataFrame:
    """(name, level) of each distinct string: the level in which the share of rows before it falls.

    Distinct strings are dealt by ranges and summed within them, so that any number of them will do.
    """
    n = df.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).repartitionByRange(F.asc_nulls_first(name))
    n = written(n.withColumn("__part", F.spark_partition_id()), "strings")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = n.groupBy("__part").agg(F.sum("__n").alias("__own"))
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("__part", F.coalesce(F.sum("__own").over(before(Window.orderBy("__part"))), F.lit(0)).alias("__start"), F.sum("__own").over(whole).alias("__all"))
    within = F.coalesce(F.sum("__n").over(before(Window.partitionBy("__part").orderBy(F.asc_nulls_first(name)))), F.lit(0))
    n = n.withColumn("__before", within).join(parts, "__part")
    return n.select(name, F.expr(f"cast((__start + __before) * {levels} div __all as int)").alias("__level"))


def quantised(df: DataFrame, dims: dict[str, Column], levels: int = LEVELS) -> DataFrame:
    """df with a column __x<i> of 0 to levels - 1 for each dimension, as numbers or strings of all rows."""
    shares = F.array(*(F.lit(i / levels) for i in range(1, levels)))
    kinds = df.select(*(e.alias(f"__v{i}") for i, e in enumerate(dims.values()))).schema
    numbers = [i for i, f in enumerate(kinds) if f.dataType.simpleString() != "string"]
    exprs = list(dims.values())
    cuts = df.agg(F.count(F.lit(1)), *(F.percentile_approx(exprs[i], shares, 10_000) for i in numbers)).first()[1:]
    for i, e in enumerate(exprs):
        df = df.withColumn(f"__v{i}", e)
        if i in numbers:
            own = sorted(set(cuts[numbers.index(i)] or ()))
            level = sum(((F.col(f"__v{i}") > F.lit(x)).cast("int") for x in own), F.lit(0))
            df = df.withColumn(f"__x{i}", F.coalesce(level, F.lit(0)))
        else:
            df = with_small(df, written(string_levels(df, f"__v{i}", levels), "string-levels"), f"__v{i}").withColumnRenamed("__level", f"__x{i}")
        df = df.drop(f"__v{i}")
    return df


def hilbert_tables(n: int) -> tuple[list[int], list[int]]:
    """(next state, digit of the index) at state * 2**n + the cell's bits, for a curve of n dimensions.

    A state is the corner where the curve enters a cube and the axis along which it crosses it:
    within, sub-cubes follow a Gray code that is turned and mirrored to fit.
    """
    full = (1 << n) - 1
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    turned = lambda b, k: ((b >> k % n) | (b << (n - k % n))) & full
    gray = [i ^ (i >> 1) for i in range(1 << n)]
    place = {g: i for i, g in enumerate(gray)}
    entry = [gray[2 * ((i - 1) // 2)] if i else 0 for i in range(1 << n)]
    axis = [0 if i == 0 else ones(i - 1 if i % 2 == 0 else i) % n for i in range(1 << n)]
    after, digit = [], []
    for corner in range(1 << n):
        for way in range(n):
            for bits in range(1 << n):
                w = place[turned(bits ^ corner, way + 1)]
                digit.append(w)
                after.append((corner ^ turned(entry[w], n - (way + 1) % n)) * n + (way + axis[w] + 1) % n)
    return after, digit


def with_hilbert_index(df: DataFrame, n: int, bits: int = BITS) -> DataFrame:
    """df with __hilbert, the place on the curve of the cell (__x0 .. __x<n-1>) of `bits` bits each."""
    after, digit = (F.array(*(F.lit(v) for v in t)) for t in hilbert_tables(n))
    state, index = F.lit(0), F.lit(0)
    for b in reversed(range(bits)):
        cell = sum((F.shiftleft(F.shiftright(f"__x{i}", b).bitwiseAND(F.lit(1)), i) for i in range(n)), F.lit(0))
        at = state * (1 << n) + cell + 1
        index = index * (1 << n) + F.element_at(digit, at)
        state = F.element_at(after, at)
    return df.withColumn("__hilbert", index.cast("int")).drop(*(f"__x{i}" for i in range(n)))


def placed(df: DataFrame, dims: dict[str, Column], tie: list[Column], size: Column, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """df with shard and slot, replaced where df has such columns."""
    if law not in ("rows", "bytes"):
        raise ValueError(f"no such law: {law}")
    df = df.drop("shard", "slot").withColumn("__size", size)
    df = written(with_hilbert_index(quantised(df, dims), len(dims)), "hilbert")
    cells = df.groupBy("__hilbert").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__w"))
    before = Window.orderBy("__hilbert").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("__hilbert", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w0"))
    total, weight = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("__size"), F.lit(0))).first()
    out = ranked(df, "__hilbert", tie, "__r", max(64, total // BUCKET_ROWS), weigh="__size")
    out = out.join(F.broadcast(cells), "__hilbert")  # at most 2 ** (bits * dimensions) rows
    rank = F.col("__n0") + F.col("__r")
    if law == "rows":
        out = out.withColumn("__rank", rank).withColumn("shard", F.expr(f"cast(__rank * {shards} div {max(total, 1)} as int)"))
        slot = F.col("__rank") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
        return out.withColumn("slot", slot).drop("__rank", "__hilbert", "__n0", "__w0", "__r", "__r_sum", "__size")
    middle = F.col("__w0") + F.col("__r_sum") + F.col("__size") / 2
    out = out.withColumn("__rank", rank).withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(weight, 1)))).cast("int"))
    out = written(out, "hilbert-cut")
    first = out.groupBy("shard").agg(F.min("__rank").alias("__first"))
    return out.join(F.broadcast(first), "shard").withColumn("slot", F.col("__rank") - F.col("__first")).drop("__rank", "__first", "__hilbert", "__n0", "__w0", "__r", "__r_sum", "__size")


DOCUMENT_DIMS = ("source", "lang", "length", "doc_id")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = text_of()
    df = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.char_length(text).alias("length"), source.alias("source"), lang.alias("lang"))
    df = written(df, "shard-meta")
    dims = {"source": F.col("source"), "lang": F.col("lang"), "length": F.col("length").cast("long"), "doc_id": F.col("doc_id").cast("long")}
    out = placed(df, dims, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.col("size"), shards, law)
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def pruning_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Least and largest value of each column by shard: what a reader skips shards by."""
    return df.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
