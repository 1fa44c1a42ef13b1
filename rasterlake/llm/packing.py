"""Operator 9: packing token sequences by linear grouping.

Texts are tokenised and cut into pieces of at most `capacity` tokens. Packing works on the counts
of each length, of which there are at most `capacity`, however many documents there are. Large
lengths are sorted and rounded up to the largest of their group, groups being of equal cardinality;
patterns for these few sizes are optimised as a linear programme (columns found by a knapsack over
the dual prices), the whole parts of its solution are used, and pieces of the groups are put
in their places. Pieces left over and small ones go best-fit, longest first, where the rest fits
most tightly. The result is a list of runs: the pieces of a length with ranks from-to lie in
consecutive sequences at one offset; a piece finds its run by its rank among those of its length.

Null texts are empty: their one token is the end token. Repeated rows are packed as often as they
occur, ties between pieces of one length go by doc_id, place and digest; an empty table gives an
empty table; other columns than doc_id and text are not read. No piece is dropped or shortened; texts
of any length are encoded whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ranked, written

CAPACITY, END = 2048, 0
#: Groups of large lengths; what is at most capacity / SMALL is small.
GROUPS, SMALL = 160, 5
#: Least pieces of a group: patterns are used a whole number of times, so few pieces want few sizes.
PER_GROUP = 32
TOKENIZER = "byte_bpe_50k"
#: Rows of one length that are sorted in one task, and buckets that each length is dealt to at least.
BUCKET_ROWS, LEAST_BUCKETS = 100_000, 64
#: Texts of these characters alone are encoded by the faster library of the same vocabulary and pattern.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ‐-‧]*")
_encoders: dict = {}


def encoder(name: str = TOKENIZER):
    """Function from texts to lists of ids, as by the tokenizers library without special tokens."""
    if name not in _encoders:
        import base64
        from pathlib import Path

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(public.path(f"{name}.json"))
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public.path(f"{name}.tiktoken")).read_bytes().splitlines())}
        fast = tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> list[int]:
            # The fast one's pattern needs stack for long runs of blanks, and it knows no special tokens.
            if len(text) < 1 << 20 and "<|" not in text and _PLAIN.fullmatch(text):
                return fast.encode_ordinary(text)
            return slow.encode(text, add_special_tokens=False).ids

        _encoders[name] = encode
    return _encoders[name]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, after a first shorter one if n isn't a multiple."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenised(batches: Iterator[pa.RecordBatch], name: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(name)
    for b in batches:
        out = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), END], "<u4")
            raw = ids.tobytes()
            out += [(doc_id, i, s, k, zlib.crc32(raw[4 * s : 4 * (s + k)])) for i, (s, k) in enumerate(cut(len(ids), capacity))]
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in _PIECES.split(", ")])


class Knapsack:
    """Best total value of sizes, each any number of times, by pairs of pairs: for sizes of which at most four fit."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        if capacity // int(sizes.min()) > 4:
            raise ValueError("more than four of the least size fit")
        self.sizes, self.capacity = sizes, capacity
        rest = np.arange(capacity + 1) - sizes[:, None]
        self.rest, self.fits = np.maximum(rest, 0), rest >= 0

    def best(self, values: np.ndarray) -> tuple[float, np.ndarray]:
        """(value, how often each size is taken)."""
        one, item = np.zeros(self.capacity + 1), np.full(self.capacity + 1, -1)
        for i in np.argsort(values, kind="stable"):
            if values[i] > 0:
                one[self.sizes[i]], item[self.sizes[i]] = values[i], i
        most = np.maximum.accumulate(one)
        at = np.maximum.accumulate(np.where((one == most) & (item >= 0), np.arange(self.capacity + 1), 0))
        both = np.where(self.fits, values[:, None] + most[self.rest], -1.0)
        first = both.argmax(axis=0)
        two = np.maximum(both[first, np.arange(self.capacity + 1)], 0)
        split = int((two + two[::-1]).argmax())
        count = np.zeros(len(self.sizes), np.int64)
        for c in (split, self.capacity - split):
            if two[c] > 0:
                i = first[c]
                count[i] += 1
                j = item[at[c - self.sizes[i]]]
                if j >= 0:
                    count[j] += 1
        return float(two[split] + two[self.capacity - split]), count


def patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, by the linear programme with least bins for all of demand.

    Columns come from the knapsack over the dual prices; the inverse of the basis is updated for
    each, and made anew now and then. It ends when no column, by the bound that prices give, can
    save one bin in ten thousand.
    """
    base, sack = np.diag((capacity // sizes).astype(float)), Knapsack(sizes, capacity)
    inverse, now = np.diag(1 / np.diag(base)), demand / np.diag(base)
    for turn in range(1, rounds + 1):
        value, column = sack.best(np.maximum(inverse.sum(axis=0), 0))
        if value <= 1 + 1e-7 or now.sum() * (1 - 1 / value) < 1e-4 * now.sum():
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, now / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        base[:, out] = column
        if turn % 64:
            row = inverse[out] / step[out]
            inverse -= np.outer(step, row)
            inverse[out] = row
        else:
            inverse = np.linalg.inv(base)
        now = inverse @ demand
    use = np.linalg.inv(base) @ demand
    return [(base[:, j].astype(np.int64), float(use[j])) for j in range(len(sizes)) if use[j] > 0]


class Bins:
    """Runs of sequences that are filled alike."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n, self.runs = capacity, 0, []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def new(self, count: int) -> int:
        self.n += count
        return self.n - count

    def put(self, length: int, rank: int, count: int, at: int, offset: int) -> None:
        self.runs.append((length, rank, rank + count, at, offset))

    def keep(self, at: int, count: int, fill: int) -> None:
        if count and fill < self.capacity:
            self.open[self.capacity - fill].append((at, count))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        while count:
            gap = min((g for g, runs in self.open.items() if g >= length and runs), default=None)
            if gap is None:
                per = self.capacity // length
                whole = count // per
                if whole:
                    at = self.new(whole)
                    for i in range(per):
                        self.put(length, rank + i * whole, whole, at, i * length)
                    self.keep(at, whole, per * length)
                    rank, count = rank + per * whole, count - per * whole
                if count:
                    at = self.new(1)
                    for i in range(count):
                        self.put(length, rank + i, 1, at, i * length)
                    self.keep(at, 1, count * length)
                return
            at, there = self.open[gap].pop()
            take = min(there, count)
            self.put(length, rank, take, at, self.capacity - gap)
            self.keep(at, take, self.capacity - gap + length)
            self.keep(at + take, there - take, self.capacity - gap)
            rank, count = rank + take, count - take


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, end rank, first sequence, offset), and the number of sequences."""
    bins = Bins(capacity)
    if full := counts.get(capacity, 0):
        bins.put(capacity, 0, full, bins.new(full), 0)
    large = sorted((n for n in counts if capacity // small < n < capacity), reverse=True)
    total = sum(counts[n] for n in large)
    groups = min(groups, max(8, total // PER_GROUP))
    # Queues of a group: [length, next rank, left], longest first; a group's size is its longest length.
    queues: list[list[list[int]]] = []
    left = 0
    for n in large:
        rank, more = 0, counts[n]
        while more:
            if not left:
                queues.append([])
                left = -(-total // groups) if total else 1
            take = min(left, more)
            queues[-1].append([n, rank, take])
            rank, more, left = rank + take, more - take, left - take
    merged: dict[int, list[list[int]]] = {}
    for q in queues:
        merged.setdefault(q[0][0], []).extend(q)
    if merged:
        sizes = np.array(list(merged), np.int64)
        stock = list(merged.values())
        demand = np.array([sum(x[2] for x in q) for q in stock], float)
        for column, use in patterns(sizes, demand, capacity):
            many = int(use + 1e-6)
            if not many:
                continue
            parts = [(bins.new(many), many, 0)]
            for g in np.repeat(np.arange(len(sizes)), column):
                filled = []
                for at, count, fill in parts:
                    while count and stock[g]:
                        head = stock[g][0]
                        take = min(count, head[2])
                        bins.put(head[0], head[1], take, at, fill)
                        filled.append((at, take, fill + head[0]))
                        at, count = at + take, count - take
                        head[1], head[2] = head[1] + take, head[2] - take
                        if not head[2]:
                            stock[g].pop(0)
                    if count:
                        filled.append((at, count, fill))
                parts = filled
            for part in parts:
                bins.keep(*part)
        rest = [tuple(x) for q in stock for x in q]
    else:
        rest = []
    rest += [(n, 0, counts[n]) for n in counts if n <= capacity // small]
    for n, rank, count in sorted(rest, reverse=True):
        bins.best_fit(n, rank, count)
    return bins.runs, bins.n


def pack(pieces: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. Each length is 1 to capacity; order tells pieces apart.

    Counts by length and the runs go through the driver: at most `capacity` counts, and runs whose
    number follows from the lengths and patterns present, not from the number of pieces.
    """
    spark = pieces.sparkSession
    counts = {int(r[0]): int(r[1]) for r in pieces.groupBy(length).count().collect()}
    runs, _ = plan(counts, capacity)
    table = spark.createDataFrame(runs, "__length long, __from long, __to long, __at long, offset long")
    buckets = max(LEAST_BUCKETS, max(counts.values(), default=0) // BUCKET_ROWS)
    out = ranked(pieces.drop("offset", "sequence_id"), length, [F.col(c) for c in order], "__rank", buckets)
    table = F.broadcast(table) if len(runs) <= BROADCAST_ROWS * 10 else table
    out = out.join(table, (F.col(length) == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return out.withColumn("sequence_id", F.col("__at") + F.col("__rank") - F.col("__from")).drop("__length", "__from", "__to", "__at", "__rank")


def packed_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(docs.mapInArrow(lambda b: _tokenised(b, tokenizer, capacity), _PIECES), "pieces")
    out = pack(pieces, ["doc_id", "piece", "ids_crc32", "start"], "length", capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
