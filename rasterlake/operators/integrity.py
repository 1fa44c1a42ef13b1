"""Integrity: shards of objects, their digests, damage by stripe, verdicts, and votes among copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digests(objects: DataFrame, key: str, content: str, prefix: int = 16) -> DataFrame:
    """(key, total_len, digest, prefix): length in bytes, SHA-256 in hex and its first digits, which name an object."""
    digest = F.sha2(F.col(content), 256)
    return objects.select(key, F.octet_length(content).alias("total_len"), digest.alias("digest"), F.substring(digest, 1, prefix).alias("prefix"))


def shards(objects: DataFrame, key: str, content: str, size: int, data_shards: int, pad: bytes | str = b"\x00") -> DataFrame:
    """(key, shard_no, stripe_no, bytes): content (binary, or a string) in pieces of size, the last one padded."""
    n = F.greatest(F.ceil(F.length(content) / F.lit(size)), F.lit(1)).cast("int")
    out = objects.select(key, F.col(content).alias("__c"), F.posexplode(F.sequence(F.lit(0), n - 1)).alias("shard_no", "__i"))
    piece = F.substring("__c", F.col("__i") * size + 1, F.lit(size))
    return out.select(key, F.col("shard_no").cast("long").alias("shard_no"), F.floor(F.col("shard_no") / data_shards).cast("long").alias("stripe_no"), F.rpad(piece, size, pad).alias("bytes"))


def damage(found: DataFrame, expected: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, stripe_no, bad) of each stripe with shards whose digest is not the expected one."""
    want = expected.select(key, "shard_no", F.col(digest).alias("__want"))
    bad = found.join(want, [key, "shard_no"], "left").where(~F.col(digest).eqNullSafe(F.col("__want")))
    return bad.groupBy(key, "stripe_no").agg(F.count(F.lit(1)).alias("bad"))


def repairable(damaged: DataFrame, key: str, parity: int) -> DataFrame:
    """(key, stripes, bad, repairable): whether parity makes up for every stripe's bad shards."""
    return damaged.groupBy(key).agg(F.count(F.lit(1)).alias("stripes"), F.sum("bad").alias("bad"), F.bool_and(F.col("bad") <= parity).alias("repairable"))


def verdict(length: Column, want_length: Column, digest: Column, want_digest: Column, quick: Column) -> Column:
    """ok (quick), ok (full) or FAILED; lengths are compared before digests."""
    failed = ~length.eqNullSafe(want_length) | ~digest.eqNullSafe(want_digest)
    return F.when(failed, F.lit("FAILED")).when(quick, F.lit("ok (quick)")).otherwise(F.lit("ok (full)"))


def first_intact(copies: DataFrame, key: str, copy_no: str, content: str, digest: str) -> DataFrame:
    """(key, copy_no, content) of the first copy whose digest is right."""
    right = copies.where(F.sha2(F.col(content), 256) == F.col(digest))
    return right.groupBy(key).agg(F.min(copy_no).alias("copy_no"), F.min_by(content, copy_no).alias("content"))
