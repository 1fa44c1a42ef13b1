"""Operator 5: exact n-gram Jaccard join by a size-aware heavy-light split.

Texts with the same shingle set form a class, and classes are joined. Two classes of at most
`boundary` shingles are found by subsets: for sizes s and u they must share `need(s, u)`
shingles, so both enumerate their subsets of just that size. All other pairs are found by
inverted lists: a set of size n posts its n - ceil(t n) + 1 rarest shingles, and a linked pair
has one of them in common. "Rarest" is by exact counts over all texts, ties by hash: groups of texts
ask for the counts of their shingles (see groups.py), by the first bits of their hashes, as many as the
corpus needs for few to share them. Shingles that occur once are in no list; one that shares its bits
with another is in a list too many. The
boundary is the one with the least cost, by the sizes present and the lists that they would scan.

In the common order, the first shingle that a linked pair shares is posted by both, at ranks i and j
from 0, and nothing before it is shared: they share at most min(n - i, m - j). A list makes only the
pairs that this bound lets link. It may rule out a pair in a list of a later common shingle, never
in that of the first. Subsets have no rank and are bounded by the sizes alone.

Lists may be large groups of near copies, so that their pairs are never all made. First every class
goes to the longest of its lists and is compared with one member there, which gathers most groups at
the cost of one pair a class. Then rounds compare the members of ranks 1, 2-4, 5-16, ... of each list
with those of its members that are not yet in the same component. When the ranks are used up, every
pair that shares a list has been compared or was already connected: components are exact.
A pair is first judged by the classes' sketches: `SKETCH_BITS` parities of shingle hashes, of which no
more can differ than shingles do, so that a pair is ruled out only if it can't link. What is left, links
for the most part, is compared by intersecting whole sets. Each class has a label, which is lowered along the links that a
round finds; links between classes whose labels differ at the end join the last components. Tables
of a round are deleted once the next is written.

Shingles and classes are known by 64-bit hashes. Null and empty texts have no shingles and are
linked with nothing; a text of fewer words than a shingle has one, its whole sequence; rows with
null or repeated ids are kept, and a null id is never a component's id unless all its ids are null.
Texts of any length are taken whole; ties between ranks go by class; an empty table gives an empty
table; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels
from .common import remove, written
from .groups import GROUP_BYTES, STRETCH, Tally, batch, distinct, packed, packed_keys, pieces_for, planes, unpacked, unpacked_keys, unplanes

#: Largest set for which subsets are considered.
MOST_SMALL = 16
#: Cost of comparing a pair, in postings.
PAIR_COST = 8
#: Growth of the ranks that a round compares.
GROWTH = 4
SKETCH_BITS = 512


def need(s: int, u: int, num: int, den: int) -> int:
    """Least common shingles of linked sets of sizes s and u."""
    return -(-num * (s + u) // (num + den))


def prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def partners(s: int, num: int, den: int) -> range:
    return range(-(-num * s // den), den * s // num + 1)


def subset_count(s: int, boundary: int, num: int, den: int) -> int:
    return sum(math.comb(s, c) for u in partners(s, num, den) if u <= boundary and (c := need(s, u, num, den)) <= min(s, u))


def best_boundary(sizes: dict[int, tuple[int, float]], num: int, den: int) -> int:
    """The boundary of least cost. sizes: sets of each small size, and what a posting of theirs meets besides itself."""
    def cost(x: int) -> float:
        total = 0.0
        for s, (sets, met) in sizes.items():
            lists = prefix(s, num, den) * (1 + PAIR_COST * met)
            total += sets * (subset_count(s, x, num, den) if s <= x else 0)
            total += sets * (lists if s > x or den * s // num > x else 0)
        return total

    return min(range(MOST_SMALL + 1), key=lambda x: (cost(x), -x))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    for b in batches:
        yield b.column("doc_id").to_pylist(), [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def _class_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


_ASKED = "kind int, part int, seq int, piece int, doc_id long, n_shingles long, cid long, texts binary, ids binary, sizes binary, keys binary, counts binary, met double"
ROW, TEXT, KEYS, SMALL = 0, 1, 2, 3


def key_bits(size: int) -> int:
    """Bits of a counted key for a corpus of so many bytes: sixteen times as many keys as bytes."""
    return min(max(int(size).bit_length() + 4, 24), 62)


def cut(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The first bits of hashes."""
    return hashes >> np.uint64(64 - bits)


def in_ranges(keys: np.ndarray, pieces: int, bits: int, *values: np.ndarray) -> Iterator[tuple]:
    """(piece, keys, values) of ascending keys in equal ranges, so that neighbours stay neighbours."""
    ends = np.searchsorted(keys, np.array([(p << bits) // pieces for p in range(pieces)] + [1 << bits], np.uint64))
    for p in np.flatnonzero(ends[1:] > ends[:-1]):
        part = slice(ends[p], ends[p + 1])
        yield int(p), keys[part], *(v[part] for v in values)


def _ask(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, pieces: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each document's class; by group, the packed texts of its classes, their shingles with counts, and what
    postings of its small sets meet in the group."""
    part, seq, size = TaskContext.get().partitionId(), 0, 0
    tally, seen, small = Tally(), set(), []

    def asked():
        keys, n = tally.sum()
        for p, own, c in in_ranges(keys, pieces, bits, n):
            yield batch(_ASKED, 1, kind=KEYS, part=part, seq=seq, piece=p, keys=[packed_keys(own)], counts=[planes(c.astype(np.uint32))])
        if small:
            met = []
            for s in small:
                c = np.sort(n[np.searchsorted(keys, cut(s, bits))])[: prefix(len(s), num, den)]
                met.append(float((c - 1).mean()))
            yield batch(_ASKED, len(small), kind=SMALL, part=part, seq=seq, n_shingles=np.array([len(s) for s in small]), met=np.array(met))

    for ids, texts in _texts(batches):
        at = 0
        while at < len(texts):
            end, room = at, STRETCH
            while end < len(texts) and (room > 0 or end == at):
                room -= len(texts[end])
                end += 1
            cids, sizes, new, kept = [], [], [], []
            for t, s in zip(texts[at:end], kernels.shingle_sets(texts[at:end], k), strict=True):
                cids.append(_class_id(s) if len(s) else None)
                sizes.append(len(s))
                if len(s) and cids[-1] not in seen:
                    seen.add(cids[-1])
                    new.append(s)
                    kept.append(t)
                    if len(s) <= MOST_SMALL:
                        small.append(s)
            yield batch(_ASKED, end - at, kind=ROW, part=part, seq=seq, doc_id=ids[at:end], n_shingles=np.array(sizes), cid=cids)
            if new:
                yield batch(_ASKED, 1, kind=TEXT, part=part, seq=seq, **packed([0] * len(kept), kept))
                tally.add(*np.unique(cut(np.concatenate(new), bits), return_counts=True))
            size += sum(map(len, texts[at:end]))
            at = end
            if size >= GROUP_BYTES:
                yield from asked()
                tally, seen, small, size, seq = Tally(), set(), [], 0, seq + 1
    yield from asked()


_TOLD = "kind int, part int, seq int, piece int, texts binary, ids binary, sizes binary, answers binary"


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For all questions of a piece: the counts of each group's keys over all groups, in their order."""
    tallies: dict[int, Tally] = {}
    asked = []
    for b in batches:
        for part, seq, piece, keys, n in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "piece", "keys", "counts")), strict=True):
            own = unpacked_keys(keys)
            tallies.setdefault(piece, Tally()).add(own, unplanes(n, np.uint32).astype(np.int64))
            asked.append((part, seq, piece, keys))
    for part, seq, piece, raw in asked:
        keys, n = tallies[piece].sum()
        got = n[np.searchsorted(keys, unpacked_keys(raw))]
        yield batch(_TOLD, 1, kind=KEYS, part=part, seq=seq, piece=piece, answers=[planes(np.minimum(got, 0xFFFFFFFF).astype(np.uint32))])


def _subsets(s: np.ndarray, boundary: int, num: int, den: int) -> Iterator[int]:
    n, own = len(s), s.tolist()
    for u in partners(n, num, den):
        if u <= boundary and (c := need(n, u, num, den)) <= min(n, u):
            for some in combinations(own, c):
                key = repr((min(n, u), max(n, u), some)).encode()
                yield int.from_bytes(hashlib.blake2b(key, digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> list[int]:
    """For each of SKETCH_BITS cells whether the number of hashes in it is odd, as words of 64 bits."""
    odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def may_be_near(num: int, den: int) -> Column:
    """Whether sets with sketches bits_a and bits_b, of n_a and n_b shingles, can link."""
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    most = F.floor((F.col("n_a") + F.col("n_b") - apart) / 2)
    return den * most >= num * (F.col("n_a") + F.col("n_b") - most)


def _signatures(batches: Iterator[pa.RecordBatch], k: int, boundary: int, num: int, den: int, pieces: int, key_size: int) -> Iterator[pa.RecordBatch]:
    """For rows sorted by group: each class's signatures, what is left of its set at each, and its sketch."""
    of, texts, told = None, [], {}

    def finished():
        # Keys are dealt by ranges, so that the answers of all pieces, in order, are those to the ascending keys.
        keys = distinct([np.unique(cut(np.concatenate(list(kernels.shingle_sets(unpacked(*row)[1], k))), key_size)) for row in texts])
        counts = np.concatenate([unplanes(told.pop(p), np.uint32) for p in sorted(told)])
        for row in texts:
            sets = list(kernels.shingle_sets(unpacked(*row)[1], k))
            asked = cut(np.concatenate(sets), key_size)
            order = np.argsort(asked)
            found = np.empty(len(asked), np.uint32)
            found[order] = counts[np.searchsorted(keys, asked[order])]
            cids, sizes, sigs, lefts, bits = [], [], [], [], []
            for s, count in zip(sets, np.split(found, np.cumsum([len(s) for s in sets])[:-1]), strict=True):
                n = len(s)
                own = np.array(list(_subsets(s, boundary, num, den)) if n <= boundary else [], np.int64)
                left = np.full(len(own), n)
                if n > boundary or den * n // num > boundary:
                    first = np.lexsort((s, count))[: prefix(n, num, den)]
                    shared = count[first] > 1
                    own = np.concatenate([own, s[first][shared].view(np.int64)])
                    left = np.concatenate([left, (n - np.arange(len(first)))[shared]])
                if len(own):
                    cids.append(_class_id(s))
                    sizes.append(n)
                    sigs.append(own)
                    lefts.append(left)
                    bits.append(sketch(s))
            ends = np.concatenate([np.zeros(1, np.int32), np.cumsum([len(x) for x in sigs], dtype=np.int32)])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (sigs, lefts)]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), *lists, pa.array(bits, pa.list_(pa.int64()))], names=["cid", "n", "sigs", "lefts", "bits"])

    for b in batches:
        for kind, part, seq, piece, answers, *row in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "seq", "piece", "answers", "texts", "ids", "sizes")), strict=True):
            if of != (part, seq):
                if texts:
                    yield from finished()
                of, texts, told = (part, seq), [], {}
            if kind == TEXT:
                texts.append(row)
            else:
                told[piece] = answers
        b = kind = answers = row = None  # the last group is worked out without its packed rows
    if texts:
        yield from finished()


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """Whether sets of n<a> and n<b> can link whose first common shingle leaves them left<a> and left<b>, itself included."""
    n_a, n_b, most = F.col(f"n{a}"), F.col(f"n{b}"), F.least(f"left{a}", f"left{b}")
    return den * most >= num * (n_a + n_b - most)


def _linked(batches, num: int, den: int):
    for b in batches:
        keep = []
        for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(den * common >= num * (len(x) + len(y) - common))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in links (a, b): the smallest node of its component.

    Labels spread along links and are then looked up at the label itself, so that the rounds grow
    with the logarithm of the longest chain; each round is a table in the shared folder.
    """
    spark = links.sparkSession
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        near = both.join(labels.toDF("v", "l"), "v").groupBy("u").agg(F.min("l").alias("l"))
        step = written(labels.join(near, labels["node"] == near["u"], "left").select("node", "label", F.least("label", "l").alias("next")), "labels")
        at = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        new = written(step.join(at, "next", "left").select("node", F.coalesce("further", "next").alias("label"), (F.col("label") != F.coalesce("further", "next")).alias("moved")), "labels")
        remove(spark, labels, step)
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            remove(spark, both)
            return labels


def _with_class(batches, k: int):
    for _, texts in _texts(batches):
        sets = [s for s in kernels.shingle_sets(texts, k) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([_class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cid", "hashes"])


def member_sets(docs: DataFrame, rows: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(cid, hashes) of the classes in members (cid), one row each."""
    if rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        # Some id does not name one row: sets are found by class among all texts.
        sets = docs.mapInArrow(lambda b: _with_class(b, k), "cid long, hashes binary").join(members, "cid", "left_semi").dropDuplicates(["cid"])
    else:
        ids = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("doc_id"))
        named = members.join(ids, "cid").select(F.col("doc_id").alias("named"))
        texts = docs.join(named.hint("merge"), docs["doc_id"] == named["named"], "left_semi")
        sets = texts.mapInArrow(lambda b: _with_class(b, k), "cid long, hashes binary")
    return written(sets, "sets")


def shared_lists(signed: DataFrame) -> DataFrame:
    """(sig, cid, n, left, size) of the lists that two classes or more have in common. size: postings, those of equal texts too."""
    posted = signed.select("cid", "n", F.inline(F.arrays_zip(F.col("sigs").alias("sig"), F.col("lefts").alias("left")))).toDF("cid", "n", "sig", "left")
    common = posted.groupBy("sig").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count(F.lit(1)).cast("int").alias("size")).where("lo <> hi").select("sig", "size")
    # The merge is asked for so that plans, and what they shuffle, are alike at every size.
    return written(posted.join(common.hint("merge"), "sig").select("sig", "cid", "n", "left", "size").distinct(), "lists")


def class_labels(docs: DataFrame, rows: DataFrame, signed: DataFrame, lists: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(cid, label) of every class in lists; label is the same for the classes of a component."""
    spark = docs.sparkSession
    labels = written(lists.select("cid", F.col("cid").alias("label")).distinct(), "roots")
    sketches = written(signed.select("cid", "n", "bits").join(labels.select("cid").hint("merge"), "cid", "left_semi").dropDuplicates(["cid"]), "sketches")
    remove(spark, signed)
    sets = member_sets(docs, rows, labels.select("cid"), k)

    def compared(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.toDF("b", "n_b", "bits_b"), "b").join(sketches.toDF("a", "n_a", "bits_a"), "a")
        pairs = written(near.where(may_be_near(num, den)).select("a", "b"), "near")
        both = pairs.join(sets.toDF("b", "set_b"), "b").join(sets.toDF("a", "set_a"), "a").select("a", "b", "set_a", "set_b")
        found = written(both.mapInArrow(lambda b: _linked(b, num, den), "a long, b long").distinct(), "found")
        remove(spark, pairs)
        return found

    def hooked(labels: DataFrame, found: DataFrame) -> DataFrame:
        """The labels after each has gone over to the least that a found link leads down to, twice."""
        if not found.limit(1).count():
            return labels
        ends = found.join(labels.toDF("a", "root_a"), "a").join(labels.toDF("b", "root_b"), "b").where("root_a <> root_b")
        down = ends.groupBy(F.greatest("root_a", "root_b").alias("high")).agg(F.min(F.least("root_a", "root_b")).alias("low"))
        out = labels.join(down, labels["label"] == down["high"], "left").select("cid", F.coalesce("low", "label").alias("label"))
        down = down.toDF("high", "lower")
        out = out.join(down, out["label"] == down["high"], "left").select("cid", F.coalesce("lower", "label").alias("label"))
        out = written(out, "roots")
        remove(spark, labels)
        return out

    # One pair a class: with the first of those that have the same longest list.
    best = lists.groupBy("cid").agg(F.max(F.struct("size", "sig", "n", "left")).alias("at")).select("cid", "at.sig", "at.n", "at.left")
    first = best.groupBy("sig").agg(F.min(F.struct("cid", "n", "left")).alias("at")).select("sig", F.col("at.cid").alias("a"), F.col("at.n").alias("n_a"), F.col("at.left").alias("left_a"))
    found = [compared(best.join(first, "sig").where((F.col("cid") != F.col("a")) & may_link("", "_a", num, den)).select("a", F.col("cid").alias("b")))]
    labels = hooked(labels, found[0])

    def still_open(lists: DataFrame, low: int) -> DataFrame:
        labelled = lists.drop("label").join(labels, "cid")
        several = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members")).where(f"lo <> hi and members > {low}").select("sig")
        return written(labelled.join(several, "sig", "left_semi").select("sig", "cid", "n", "left", "label"), "open")

    rest, low, high = still_open(lists, 0), 0, 1
    while rest.limit(1).count():
        rank = F.row_number().over(Window.partitionBy("sig").orderBy("cid"))
        pivots = rest.withColumn("rank", rank).where(f"rank <= {high}").where(f"rank > {low}").select("sig", F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("label").alias("label_a"))
        # Ranks go by class: a member is compared with the pivots before it.
        pairs = rest.join(pivots, "sig").where((F.col("label") != F.col("label_a")) & (F.col("cid") > F.col("a")) & may_link("", "_a", num, den))
        found.append(compared(pairs.select("a", F.col("cid").alias("b")).distinct()))
        labels = hooked(labels, found[-1])
        before, rest = rest, still_open(rest, high)
        remove(spark, before)
        low, high = high, high * GROWTH

    # Links whose ends have different labels still: few, since each pass has taken every label down.
    apart = reduce(DataFrame.union, found).join(labels.toDF("a", "root_a"), "a").join(labels.toDF("b", "root_b"), "b").where("root_a <> root_b")
    apart = written(apart.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), "apart")
    if apart.limit(1).count():
        new = components(apart).withColumnRenamed("label", "new")
        labels = written(labels.join(new, labels["label"] == new["node"], "left").select("cid", F.coalesce("new", "label").alias("label")), "roots")
    remove(spark, sketches, sets, rest, apart, *found)
    return labels


def jaccard_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id, label, component_id of every row: linked means den * common >= num * union.

    Rows with equal shingle sets have one class_id, those of one component one label; both are null
    for rows without shingles. component_id is the smallest doc_id of the component, for rows
    without shingles their own.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces, bits = pieces_for(size), key_bits(size)
    asked = written(docs.mapInArrow(lambda b: _ask(b, k, num, den, pieces, bits), _ASKED), "asked", "zstd")
    rows = written(asked.where(F.col("kind") == ROW).select("doc_id", "n_shingles", "cid"), "classes")
    parts, groups = (1 + (x or 0) for x in asked.agg(F.max("part"), F.max("seq")).first())
    # A group's counts stand for all groups': they set the boundary alone.
    sizes = asked.where(F.col("kind") == SMALL).groupBy("n_shingles").agg(F.count(F.lit(1)).alias("sets"), F.avg("met").alias("met")).collect()
    boundary = best_boundary({r.n_shingles: (r.sets, r.met * parts * groups) for r in sizes}, num, den)
    told = asked.where(F.col("kind") == KEYS).select("part", "seq", "piece", "keys", "counts").repartitionById(pieces, F.col("piece")).mapInArrow(_total, _TOLD)
    told = told.unionByName(asked.where(F.col("kind") == TEXT).select("kind", "part", "seq", "texts", "ids", "sizes"), allowMissingColumns=True)
    told = told.repartitionById(parts * groups, F.expr(f"seq * {parts} + part")).sortWithinPartitions("seq", "part")
    signed = written(told.mapInArrow(lambda b: _signatures(b, k, boundary, num, den, pieces, bits), "cid long, n long, sigs array<long>, lefts array<long>, bits array<long>"), "signatures")
    remove(spark, asked)
    lists = shared_lists(signed)
    labels = class_labels(docs, rows, signed, lists, k, num, den)
    remove(spark, lists)
    ids = rows.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("least"))
    of = ids.join(labels, "cid")
    of = of.join(of.groupBy("label").agg(F.min("least").alias("all")), "label").select(F.col("cid").alias("linked"), "label", "all")
    ids = ids.join(of, ids["cid"] == of["linked"], "left").select("cid", F.coalesce("label", "cid").alias("label"), F.coalesce("all", "least").alias("least"))
    component = F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return rows.join(ids, "cid", "left").select("doc_id", "n_shingles", F.col("cid").alias("class_id"), "label", component.alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return jaccard_classes(docs, k, num, den).drop("class_id", "label")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs (doc_id, text and others) without near duplicates: one row of each component stays.

    That is a row with the smallest doc_id; where rows of one component share it, or have no doc_id,
    the one with the least class, and of rows of one class any. Rows without words all stay. Rows are
    told apart by doc_id where each has its own, else by doc_id and class.
    """
    found = written(jaccard_classes(docs, k, num, den), "groups")
    own = found.where("class_id is not null")
    stays = own.where("doc_id <=> component_id").groupBy("label").agg(F.min("class_id").alias("__class"), F.first("component_id").alias("__id"))
    gone = own.where("not (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone")).distinct()
    several = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__several")), "several")
    if not several.limit(1).count():
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    once = docs.join(several, docs["doc_id"].eqNullSafe(several["__several"]), "left_anti")
    once = once.join(gone, once["doc_id"] == gone["__gone"], "left_anti")

    @F.pandas_udf("long")
    def class_of(col):
        import pandas as pd

        texts = [t.encode("utf-8", "surrogatepass") for t in col.fillna("")]
        return pd.Series([_class_id(s) if len(s) else None for s in kernels.shingle_sets(texts, k)], index=col.index, dtype="Int64")

    more = docs.join(several, docs["doc_id"].eqNullSafe(several["__several"]), "left_semi").withColumn("__of", class_of(F.col("text").cast("string")))
    more = written(more, "repeated")
    wordless = more.where("__of is null").drop("__of")
    more = more.join(stays, (more["__of"] == stays["__class"]) & more["doc_id"].eqNullSafe(stays["__id"]), "left_semi").dropDuplicates(["doc_id", "__of"]).drop("__of")
    return once.unionByName(wordless).unionByName(more)
