"""New files as a stream: each file is read once, and a checkpoint says which have been."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def new_files(spark: SparkSession, folder: str, glob: str = "*", per_trigger: int = 1000) -> DataFrame:
    """path, modificationTime, length, digest of the files that arrive in a folder."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder)
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("digest"))


def catalogue(files: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what has arrived to a table of Parquet files, once, and ends."""
    return files.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose digest is not the one known for their path: bit rot, or an edit."""
    return files.join(known.select("path", F.col("digest").alias("was")), "path").where(~F.col("digest").eqNullSafe(F.col("was")))
