"""Helpers that several operators share: the shared folder, words in SQL, bounded broadcasts."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word of the contracts: a run of anything but space and the ASCII controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Most rows of a table that is handed to every task; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set and all is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rasterlake-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Seconds of a write after which its shuffle files are worth a collection in the driver.
LONG_WRITE = 2.0
_due: list[str] = []


def forget(spark: SparkSession) -> None:
    """Has Spark delete the shuffle files of queries that nothing holds any more."""
    _due.clear()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and outlives lost executors.

    The shuffle files of the query that makes it are of no use afterwards. Spark deletes them on all
    executors once the driver has collected the query, which is asked for after a long write and
    again before the next one, when nothing holds the query any more.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _due:
        forget(spark)
    began = time.perf_counter()
    df.write.option("compression", compression).parquet(path)
    if time.perf_counter() - began > LONG_WRITE:
        _due.append(name)
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that written() made and that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for df in tables for x in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(f)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def with_small(df: DataFrame, small: DataFrame, on: str, most: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """df left-joined with small by the nullable key on (nulls match nulls).

    small has one row a key. Up to most rows (counted) it is broadcast; beyond, it is copied
    once for each of salts and joined by (key, salt), so that a hot key meets in many tasks.
    """
    small = small.withColumnRenamed(on, "__small_key")
    same = F.col(on).eqNullSafe(F.col("__small_key"))
    if small.limit(most + 1).count() <= most:
        return df.join(F.broadcast(small), same, "left").drop("__small_key")
    salted = small.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = df.withColumn("__salt_l", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return left.join(salted, same & (F.col("__salt_l") == F.col("__salt_r")), "left").drop("__small_key", "__salt_l", "__salt_r")


def ranked(df: DataFrame, group: str, order: list[Column], rank: str, buckets: int = 256, weigh: str | None = None) -> DataFrame:
    """df with `rank`: each row's place from 0 in its group, and with weigh the sum before it in `<rank>_sum`.

    A group may hold any share of the rows: its rows are dealt to buckets by the hash of order's
    columns, and only a bucket is sorted in one task. Rows that are equal in all of them are told
    apart as they come. The order is by bucket first, the same on every run.
    """
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    n = df.groupBy(group, "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.sum(weigh if weigh else F.lit(0)).alias("__w"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__w"))
    at = Window.partitionBy(group, "__bucket").orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(at) - 1)
    if weigh:
        df = df.withColumn("__s", F.coalesce(F.sum(weigh).over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.join(n, [group, "__bucket"]).withColumn(rank, F.col("__n") + F.col("__i"))
    if weigh:
        df = df.withColumn(f"{rank}_sum", F.col("__w") + F.col("__s"))
    return df.drop("__bucket", "__n", "__w", "__i", "__s")
