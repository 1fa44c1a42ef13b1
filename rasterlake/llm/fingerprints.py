"""Operator 1: document fingerprints as threshold-scaled sketches.

A sketch keeps every 48-bit shingle hash below one part in `SCALE` of the range; a text whose hashes
all lie above keeps its smallest one, so that only a text without words has an empty sketch.
The rule looks at one hash at a time, so sketches of parts merge into that of the whole (their
union, cut again), and containment of a short text in a long one is estimated without bias.

Nulls and empty texts give an empty sketch; equal texts have equal sketches; texts of any length
are sketched whole. Rows with a null or repeated doc_id are kept, and stand next to each other in
the order (doc_id, text), in one range. An empty table gives an empty table; fingerprints() replaces
a column of that name and keeps all others, edited_fingerprints() reads doc_id and text alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import partitions

#: One hash in so many is kept; a document of 500 words keeps about 250. The bits of a hash that are left out.
SCALE, CUT_BITS = 2, 16
SHINGLE_WORDS = 5
#: Text of a range of doc_ids, which one task works on.
RANGE_BYTES = 64 << 20
#: Rows sampled by hash for each cut of the doc_id range.
SAMPLE_PER_CUT = 20


def cut_to_scale(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of distinct ascending hashes."""
    return hashes[: max(np.searchsorted(hashes, np.uint64(min((1 << 64) // scale, (1 << 64) - 1)), "right"), 1)]


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two texts' shingles."""
    return cut_to_scale(np.union1d(a, b), scale)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all of either; 1 for two empty sketches."""
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has too; 1 where a is empty."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def encoded(sketch: np.ndarray) -> str:
    """Six bytes a hash, the highest first."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, 6)
    return np.concatenate([raw, np.zeros((len(raw), 2), np.uint8)], axis=1).reshape(-1).view(">u8").astype(np.uint64)


def sketches(texts: Iterable[str], k: int = SHINGLE_WORDS, scale: int = SCALE) -> Iterator[np.ndarray]:
    most, cut = min((1 << 64) // scale, (1 << 64) - 1), np.uint64(CUT_BITS)
    for group in kernels.grouped(t.encode("utf-8", "surrogatepass") for t in texts):
        h, first = kernels.shingles(*kernels.words(group), k)
        h = h >> cut << cut
        low = np.flatnonzero(h <= np.uint64(most))
        at = np.searchsorted(low, first)
        for i in range(len(group)):
            own = np.unique(h[low[at[i] : at[i + 1]]])
            if not len(own) and first[i] < first[i + 1]:
                own = h[first[i] : first[i + 1]].min(keepdims=True)
            yield own


def fingerprints(df: DataFrame, text: str = "text", k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """df with a column `fingerprint`; it replaces a column of that name."""
    @F.pandas_udf("string")
    def of(col):
        import pandas as pd

        return pd.Series([encoded(s) for s in sketches(col.fillna(""), k, scale)], index=col.index, dtype=object)

    return df.withColumn("fingerprint", of(F.col(text)))


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_next double, n_kept long"


def _pairs(rows: Iterator[tuple]) -> Iterator[tuple[int, str, str]]:
    """(doc_id, text, next text) for rows (piece, tail, doc_id, text) in order.

    A piece ends with the first row of the next piece, marked as tail, and perhaps others like it.
    """
    before = None
    for piece, tail, doc_id, text in rows:
        text = text or ""
        if before is not None and before[0] == piece:
            yield before[1], before[2], text
        before = None if tail else (piece, doc_id, text)


def _edited(batches: Iterator[pa.RecordBatch], k: int, scale: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("piece", "tail", "doc_id", "text")), strict=True)

    def flush(group):
        texts, edits = [], []
        for _, t, nxt in group:
            half = len(t) // 2
            edits.append(t[: len(t) - half] + nxt[:half])
            texts += [t, edits[-1], nxt]
        s = list(sketches(texts, k, scale))
        out = []
        for i, (doc_id, t, _) in enumerate(group):
            a, e, n = s[3 * i : 3 * i + 3]
            out.append((doc_id, len(t), hashlib.sha256(edits[i].encode("utf-8", "surrogatepass")).hexdigest(), encoded(a), encoded(e), jaccard(a, e), jaccard(a, n), containment(a, n), len(a)))
        names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in EDIT_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    group, size = [], 0
    for p in _pairs(rows()):
        group.append(p)
        size += 2 * len(p[1]) + len(p[2])
        if size > 4 << 20:
            yield flush(group)
            group, size = [], 0
    if group:
        yield flush(group)


def edited_fingerprints(docs: DataFrame, k: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Fingerprints of every text and of its edit with the next document (descending doc_id).

    Texts are dealt once by ranges of doc_id between cuts that are ids of the table, found on a
    sample by hash; the row at a cut also ends the range before it, and the row with the largest
    id the last one. Only cuts (one for each RANGE_BYTES of text) come to the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n, largest, size = docs.agg(F.count(F.lit(1)), F.max("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(partitions(spark), size // RANGE_BYTES)
    every = max(1, n // (parts * SAMPLE_PER_CUT))
    ids = sorted((r[0] for r in docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)).distinct().collect()), reverse=True)
    # Cut p is the first id of range p; nulls come last, in the last range.
    cuts = sorted({ids[i * len(ids) // parts] for i in range(1, parts)} - {largest} if ids else set())
    last = len(cuts)

    @F.pandas_udf("array<int>")
    def pieces(col, null):
        import pandas as pd

        bounds, v = np.array(cuts, np.int64), col.fillna(0).astype("int64").to_numpy()
        at = np.where(null, last, last - np.searchsorted(bounds, v, "left")) if last else np.zeros(len(v), int)
        out = []
        for p, x, gone in zip(at, v, null, strict=True):
            first = (largest is None) if gone else x == largest
            cut = not gone and last > 0 and p > 0 and bounds[last - p] == x
            # 2p: a row of piece p; 2p + 1: its tail
            out.append([2 * int(p), *([2 * last + 1] if first else []), *([2 * int(p) - 1] if cut else [])])
        return pd.Series(out, index=col.index)

    dealt = docs.withColumn("code", F.explode(pieces(F.col("doc_id"), F.col("doc_id").isNull()))).select(F.expr("code div 2").cast("int").alias("piece"), (F.col("code") % 2 == 1).alias("tail"), "doc_id", "text")
    dealt = dealt.repartitionById(last + 1, F.col("piece")).sortWithinPartitions("piece", "tail", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(lambda batches: _edited(batches, k, scale), EDIT_SCHEMA)
