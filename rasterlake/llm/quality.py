"""Operator 3: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule says which rows it rejects. Its cost (seconds a row) and selectivity (share of rows
rejected) are measured on a bounded sample; the rules then run in the order of rejection per
cost, as one CASE expression, which stops at a row's first rejecting rule. A row is kept if no
rule rejects it, so the order changes the time and the rule named, never the verdict.

Null and empty texts have no words and are rejected by min_words; texts of any length are read whole.
Rows are never merged, so repeated rows stay repeated; rules equal in rejection per cost go by name;
an empty table gives an empty table. Other columns pass through, but those named __q_* are replaced.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_of, words_of

#: Rows on which costs and selectivities are estimated, and bytes of one: they set nothing but the order.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_SHARE = 400, 32 << 10, 0.02
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words")


@dataclass(frozen=True)
class Rule:
    """Rejects rows where `fails` holds; `needs` are the features that it reads."""

    name: str
    needs: tuple[str, ...]
    fails: str


#: min_words and repeats are the contract's; the others reject text that is hardly prose.
RULES = (
    Rule("min_words", ("n_words",), "{n_words} < 50"),
    Rule("repeats", ("n_repeat_words", "n_words"), "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("word_length", ("word_chars", "n_words"), "{word_chars} < 2 * {n_words} OR {word_chars} > 15 * {n_words}"),
    Rule("symbols", ("n_symbols", "n_words"), "10 * {n_symbols} > {n_words}"),
    Rule("dup_lines", ("n_dup_lines", "n_lines"), "10 * {n_dup_lines} > 4 * {n_lines}"),
    Rule("letters", ("n_letter_words", "n_words"), "10 * {n_letter_words} < 7 * {n_words}"),
    Rule("capitals", ("n_capital_words", "n_words"), "10 * {n_capital_words} > 4 * {n_words}"),
)
BASE = ("min_words", "repeats")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """df with __q_text and __q_words, from which features are made."""
    df = df.withColumn("__q_text", text_of(text))
    return df.withColumn("__q_words", words_of(F.col("__q_text")))


def with_features(df: DataFrame, only: tuple[str, ...] = FEATURES, where: Column | None = None) -> DataFrame:
    """with_words() with __q_<feature> for each feature asked for; null for rows that `where` leaves out.

    The arrays that several expressions read are columns of projections of their own, so that
    each is made once for a row.
    """
    c = F.col
    text = c("__q_text") if where is None else F.when(where, c("__q_text"))
    df = df.withColumn("__q_w", c("__q_words") if where is None else F.when(where, c("__q_words")))
    if "n_words" in only:
        df = df.withColumn("__q_n_words", F.size("__q_w").cast("long"))
    if "word_chars" in only:
        df = df.withColumn("__q_word_chars", _sum(F.transform("__q_w", lambda w: F.char_length(w).cast("long"))))
    if "n_letter_words" in only:
        df = df.withColumn("__q_n_letter_words", F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}")).cast("long"))
    if "n_capital_words" in only:
        df = df.withColumn("__q_n_capital_words", F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])\p{Lu}{3}")).cast("long"))
    if "n_symbols" in only:
        df = df.withColumn("__q_n_symbols", F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"))
    if {"n_lines", "n_dup_lines"} & {*only}:
        df = df.withColumn("__q_lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)))
        df = df.withColumn("__q_n_lines", F.size("__q_lines").cast("long"))
        df = df.withColumn("__q_n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
    if "n_repeat_words" in only:
        # Windows are compared by a 64-bit hash of their three words.
        n = F.size("__q_w")
        df = df.withColumn("__q_h", F.transform("__q_w", lambda w: F.xxhash64(w)))
        pairs = F.zip_with("__q_h", F.slice("__q_h", F.lit(2), n), lambda a, b: F.xxhash64(a, b))
        df = df.withColumn("__q_h", F.slice(F.zip_with(pairs, F.slice("__q_h", F.lit(3), n), lambda p, x: F.xxhash64(p, x)), F.lit(1), F.greatest(n - 2, F.lit(0))))
        df = df.withColumn("__q_s", F.when(F.size(F.array_distinct("__q_h")) == F.size("__q_h"), F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        twice = F.zip_with("__q_s", F.slice("__q_s", F.lit(2), n), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
        df = df.withColumn("__q_s", F.sort_array(F.array_distinct(F.flatten(twice))))
        gaps = F.zip_with("__q_s", F.slice("__q_s", F.lit(2), n), lambda a, b: F.when(b.isNull(), 3).otherwise(F.least(F.lit(3), b - a)).cast("long"))
        df = df.withColumn("__q_n_repeat_words", _sum(gaps))
    return df.drop("__q_w", "__q_lines", "__q_h", "__q_s")


def _fails(rule: Rule) -> Column:
    return F.expr(rule.fails.format(**{f: f"__q_{f}" for f in FEATURES}))


def measured(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds a row and its share of rejected rows, on a bounded sample."""
    texts = df.select(F.col(text).cast("string").alias(text)).where(F.coalesce(F.octet_length(text), F.lit(0)) <= SAMPLE_BYTES)
    # Sampled rows come from many partitions; a small table gives its first rows.
    sample = [r[0] for r in texts.sample(SAMPLE_SHARE, 7).limit(rows).collect()]
    if len(sample) < rows // 4:
        sample = [r[0] for r in texts.limit(rows).collect()]
    if not sample:
        return [(r, 0.0, 0.0) for r in rules]
    small = df.sparkSession.createDataFrame([(x,) for x in sample], f"`{text}` string").coalesce(1).cache()
    out = []
    try:
        small.count()
        for rule in rules:
            job = with_features(with_words(small, text), rule.needs).agg(F.avg(_fails(rule).cast("double")))
            began = time.perf_counter()
            rejected = job.first()[0]
            out.append((rule, (time.perf_counter() - began) / len(sample), rejected or 0.0))
    finally:
        small.unpersist()
    return out


def ordered(costs: list[tuple[Rule, float, float]]) -> tuple[Rule, ...]:
    """By rejection per cost, the highest first; by name where equal."""
    return tuple(r for r, cost, share in sorted(costs, key=lambda x: (-x[2] / max(x[1], 1e-9), x[0].name)))


def cascade(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, order: tuple[Rule, ...] | None = None) -> DataFrame:
    """df with `rejected_by`: the first rule, in the measured order, that rejects the row; null if kept.

    A text is split into words once. Features are made rule by rule behind the CASE that says
    whether the row is still open, so that a rejected row costs no more.
    """
    order = order or ordered(measured(df, text, rules))
    return _decided(with_words(df, text), order).drop("__q_text", "__q_words", *(f"__q_{f}" for f in FEATURES))


def _decided(df: DataFrame, order: tuple[Rule, ...]) -> DataFrame:
    """with_words() with rejected_by; features that are there already are not made again."""
    df = df.withColumn("__q_by", F.lit(None).cast("string"))
    for rule in order:
        missing = tuple(f for f in rule.needs if f"__q_{f}" not in df.columns)
        if missing:
            df = with_features(df, missing, F.col("__q_by").isNull())
        df = df.withColumn("__q_by", F.when(F.col("__q_by").isNotNull(), F.col("__q_by")).when(_fails(rule), F.lit(rule.name)))
    # Through an expression that counts as not deterministic no filter is pushed: it would be
    # written out in terms of the text, twice as large for each rule.
    return df.withColumn("rejected_by", F.when(F.monotonically_increasing_id() >= 0, F.col("__q_by"))).drop("__q_by")


#: What the report returns of every row; the other features are made behind the CASE alone.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_report(docs: DataFrame) -> DataFrame:
    """Base counts and verdict of every document, by the cascade over the reported features and its own."""
    c = F.col
    order = ordered(measured(docs, "text"))
    df = _decided(with_features(with_words(docs.select("doc_id", "text")), REPORTED), order)
    base = F.lit(False)
    for rule in (r for r in RULES if r.name in BASE):
        base = base | _fails(rule)
    return df.select("doc_id", *(c(f"__q_{f}").alias(f) for f in REPORTED), base.alias("base_failed"), c("rejected_by").isNull().alias("kept"))
