"""The corpus pipeline: quality rules, line dedup, near duplicates, mixing and packing, in that order.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the
last return the columns of `documents`, whatever others docs has and whatever their names; run()
writes each stage's rows to the shared folder and reads them again, so that a lost executor costs one
stage at most. Each stage takes nulls in any column, empty and very long texts, repeated rows and
empty tables (which give empty tables):

- quality_rules drops null and empty texts, which have no words, and judges repeated rows alike.
- line_dedup keeps null texts and rows without a doc_id as they are; of documents that share a line or
  passage the one with the smallest doc_id keeps it.
- near_duplicates keeps the row with the smallest doc_id of each group, one of equal rows, and all
  without words; rows with repeated or no doc_id are told apart by their texts.
- mixing takes null sources for one source, and null texts for 0 words; equal doc_ids go together.
- packing takes null texts for empty ones, of one token, and cuts long texts into pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import jaccard_join, line_templates, mixing, packing, quality
from rasterlake.llm.common import WORD, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Five-word shingles and a similarity of 0.8 or more.
SHINGLE_WORDS, NUM, DEN = 5, 80, 100


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    kept = quality.cascade(docs.select(*COLUMNS))
    return kept.where("rejected_by is null").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that recur in others; those with no word left go."""
    out = line_templates.dedup_lines(docs.select(*COLUMNS))
    left = F.char_length("text")
    cut = F.col("n_dropped") + F.col("n_passages") > 0
    out = out.where(~cut | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.when(cut, left.cast("long")).otherwise(F.col("n_chars").cast("long"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    return jaccard_join.one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, NUM, DEN)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.packed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Near duplicates and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
