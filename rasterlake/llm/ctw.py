"""Operator 2: language-model scoring by context-tree weighting.

A byte is coded as eight binary decisions. Each decision has a context tree over the `DEPTH` bytes
before it: a node counts the zeros and ones seen there, estimates the next bit by Krichevsky and
Trofimov's rule, and is mixed with its children by the weights of context-tree weighting, which
compare how well the node and its children code all training bits. Nodes never seen in training
leave the decision to their parent. Texts are lower-cased (A-Z), and end with a byte that no UTF-8
text has, so that probabilities of texts sum to one.

The model is exact and grows with the corpus: no node and no word is left out, and none is handed
to every task. Instead, groups of texts ask for what they need:

1. Each task cuts its texts into groups and passes them on with the group's distinct keys (contexts
   with their byte, and words) and their training counts, dealt to pieces by hash.
2. A piece's counts are added up, then contexts are sorted so that all contexts with the same last
   two bytes meet. Their subtrees are worked out one after the other, twice: first for the sums of
   the nodes at depth 1, of which 65,280 are possible, then for the probability of each key.
3. Each piece answers each group's keys in their order, and a group's texts, which travel packed, are
   scored with its answers alone.

Memory follows the size of a group, the distinct keys of a piece and the contexts with two bytes in
common. Words are known by 64-bit hashes. A long text is scored in stretches that carry its context.

Null texts are empty (one token, the end); a null doc_id counts as the text '' and so is held out;
repeated rows are learnt from and scored each; without training texts the model gives each bit 1/2;
an empty table gives an empty table; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import written
from .groups import GROUP_BYTES, STRETCH, Answers, Tally, by_piece, packed_keys, pieces_for, planes, unpacked_keys, unplanes
from .groups import batch as _batch
from .groups import packed as _packed
from .groups import texts_of as _texts
from .groups import unpacked as _unpacked

DEPTH = 5
#: Keys that a group has at most before it ends; asked keys for each task that answers.
GROUP_KEYS, ANSWERED = 2 << 20, 16 << 20
#: Sorted keys of whole two-byte contexts that are worked out at once.
TREE_KEYS = 1 << 17
HELD_OUT = 10
U64 = np.uint64
WORD, GRAM, TEXT = 0, 1, 2
END = b"\xff"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % HELD_OUT == 0


def stretches(texts: list[bytes], most: int = STRETCH) -> Iterator[tuple[np.ndarray, list[bytes], list[bytes]]]:
    """The texts with their end bytes as runs of about `most` bytes: (each one's text, bytes before it, its bytes)."""
    owner, before, body, size = [], [], [], 0
    for i, t in enumerate(texts):
        t += END
        for at in range(0, len(t), most):
            owner.append(i)
            before.append(t[at - DEPTH : at] if at else bytes(DEPTH))
            body.append(t[at : at + most])
            size += len(body[-1])
            if size >= most:
                yield np.array(owner), before, body
                owner, before, body, size = [], [], [], 0
    if owner:
        yield np.array(owner), before, body


def codes(before: list[bytes], body: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context and byte of every position, first place of each body).

    A code has the byte lowest and the byte just before it highest, so that sorted codes have
    contexts with a common end side by side.
    """
    joined = np.frombuffer(b"".join(x + y for x, y in zip(before, body, strict=True)), np.uint8)
    joined = np.where((joined >= 65) & (joined <= 90), joined + 32, joined).astype(U64)
    n = np.fromiter((len(x) for x in body), np.int64, len(body))
    out = joined.copy()
    for k in range(1, DEPTH + 1):
        out[k:] |= joined[: len(joined) - k] << U64(8 * (DEPTH + 1 - k))
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
    starts = first[:-1] + DEPTH * np.arange(len(n))
    keep = np.ones(len(joined), bool)
    keep[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return out[keep], first


_ASKED = "kind int, part int, seq int, piece int, texts binary, ids binary, sizes binary, keys binary, counts binary, n long"
def _tally(tallies: dict[int, Tally], texts: list[bytes], learnt: np.ndarray) -> None:
    """Adds the keys of texts, and how often those that are learnt from have them."""
    def add(kind: int, keys: np.ndarray, trains: np.ndarray) -> None:
        own = keys[trains]
        if len(own):
            tallies[kind].add(*np.unique(own, return_counts=True))
        if len(own) < len(keys):
            others = np.unique(keys[~trains])
            tallies[kind].add(others, np.zeros(len(others), np.int64))

    for owner, before, body in stretches(texts):
        code, first = codes(before, body)
        add(GRAM, code, np.repeat(learnt[owner], np.diff(first)))
    start = 0
    for group in kernels.grouped(texts):
        words, first = kernels.words(group)
        add(WORD, words, np.repeat(learnt[start : start + len(group)], np.diff(first)))
        start += len(group)


def _ask(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    part, seq = TaskContext.get().partitionId(), 0
    tallies, size = {WORD: Tally(), GRAM: Tally()}, 0

    def asked():
        for kind, tally in tallies.items():
            for p, keys, n in by_piece(pieces, *tally.sum()):
                yield _batch(_ASKED, 1, kind=kind, part=part, seq=seq, piece=p, keys=[packed_keys(keys)], counts=[planes(n.astype(np.uint32))], n=len(keys))

    for b in batches:
        ids, texts, at = b.column("doc_id").to_pylist(), _texts(b.column("text")), 0
        while at < len(texts):
            end, room = at, STRETCH
            while end < len(texts) and (room > 0 or end == at):
                room -= len(texts[end])
                end += 1
            learnt = np.array([not held_out(i) for i in ids[at:end]])
            yield _batch(_ASKED, 1, kind=TEXT, part=part, seq=seq, n=int(learnt.sum()), **_packed(ids[at:end], texts[at:end]))
            _tally(tallies, texts[at:end], learnt)
            size += sum(map(len, texts[at:end]))
            at = end
            if size >= GROUP_BYTES or any(t.held > GROUP_KEYS and len(t.sum()[0]) > GROUP_KEYS for t in tallies.values()):
                yield from asked()
                tallies, size, seq = {WORD: Tally(), GRAM: Tally()}, 0, seq + 1
    yield from asked()


_COUNTED = "kind int, piece int, key long, n long, keys binary, counts binary, tokens long, known long"
SLICE = 1 << 16


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of one or more pieces: words as slices of keys with their counts, contexts as rows."""
    tallies: dict[tuple[int, int], Tally] = {}
    for b in batches:
        for kind, piece, keys, n in zip(*(b.column(c).to_pylist() for c in ("kind", "piece", "keys", "counts")), strict=True):
            tallies.setdefault((kind, piece), Tally()).add(unpacked_keys(keys), unplanes(n, np.uint32).astype(np.int64))
    for (kind, piece), tally in tallies.items():
        keys, n = tally.sum()
        for at in range(0, len(keys), SLICE):
            k, c = keys[at : at + SLICE], n[at : at + SLICE]
            if kind == WORD:
                yield _batch(_COUNTED, 1, kind=kind, piece=piece, keys=[packed_keys(k)], counts=[planes(c.astype(float))], tokens=int(c.sum()), known=int((c > 0).sum()))
            else:
                yield _batch(_COUNTED, len(k), kind=kind, piece=piece, key=k.view(np.int64), n=c)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """For x of 1/2 or more, by Stirling's series above 10."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(10):
        low = y < 10
        shift[low] -= np.log(y[low])
        y[low] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)


_HALVES, _WHOLES = log_gamma(np.arange(4096) + 0.5), log_gamma(np.arange(8192) + 1.0)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that Krichevsky and Trofimov's rule gives a sequence with these counts."""
    out = np.empty(len(zeros))
    low = (zeros < 4096) & (ones < 4096)
    a, b = zeros[low].astype(np.int64), ones[low].astype(np.int64)
    out[low] = _HALVES[a] + _HALVES[b] - _WHOLES[a + b]
    a, b = zeros[~low], ones[~low]
    out[~low] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0)
    return out - math.log(math.pi)


class Level:
    """The nodes of one depth, for the eight decisions of a byte.

    keys: distinct (context of that depth, byte), ascending; n: their counts; up: for each key one
    level deeper its place here.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, up: np.ndarray | None = None) -> None:
        self.keys, self.n, self.up = keys, n, up

    def decide(self, bit: int, below: Level | None) -> None:
        """node: each key's node; zeros, ones; weight: log probability of the subtree; odds: of the node's own estimate against its children's."""
        prefix = self.keys >> U64(8 - bit)
        new = np.ones(len(prefix), bool)
        new[1:] = prefix[1:] != prefix[:-1]
        self.first = np.flatnonzero(new)
        self.node = np.cumsum(new) - 1
        one = ((self.keys >> U64(7 - bit)) & U64(1)).astype(bool)
        self.ones = np.add.reduceat(np.where(one, self.n, 0.0), self.first)
        self.zeros = np.add.reduceat(np.where(one, 0.0, self.n), self.first)
        own = log_kt(self.zeros, self.ones)
        if below is None:
            self.weight, self.odds = own, np.full(len(own), 30.0)
        else:
            children = np.bincount(self.node[below.up[below.first]], below.weight, len(own))
            self.weight, self.odds = np.logaddexp(own, children) - math.log(2), np.clip(own - children, -30, 30)


def shorter(level: Level) -> Level:
    """The level one byte of context less: the byte farthest back goes."""
    cut = ((level.keys >> U64(16)) << U64(8)) | (level.keys & U64(0xFF))
    keys, level.up = np.unique(cut, return_inverse=True)
    return Level(keys, np.bincount(level.up, level.n, len(keys)))


def levels(keys: np.ndarray, n: np.ndarray, to: int) -> list[Level]:
    """From depth DEPTH down to `to`."""
    out = [Level(keys, n.astype(float))]
    for _ in range(DEPTH - to):
        out.append(shorter(out[-1]))
    return out


def mixed(p: np.ndarray, known: np.ndarray, zeros, ones, odds) -> tuple[np.ndarray, np.ndarray]:
    """Probability of a one, with a node's estimate mixed into that of the nodes below it."""
    seen = zeros + ones > 0
    share = np.where(known, 1 / (1 + np.exp(-odds)), 1.0)
    return np.where(seen, share * ((ones + 0.5) / (zeros + ones + 1)) + (1 - share) * p, p), known | seen


class Top:
    """Depths 0 and 1 by node number: (byte of context, bits so far)."""

    def __init__(self, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> None:
        self.tables = {}
        for d in (1, 0):
            at = node & ((1 << (8 * d + 8)) - 1)
            zeros, ones, below = (np.bincount(at, x, 1 << (8 * d + 8)) for x in (zeros, ones, below))
            own = log_kt(zeros, ones)
            self.tables[d] = zeros, ones, np.clip(own - below, -30, 30)
            seen = np.flatnonzero(zeros + ones > 0)
            node, zeros, ones, below = seen, zeros[seen], ones[seen], (np.logaddexp(own, below) - math.log(2))[seen]

    def mix(self, byte: np.ndarray, last: np.ndarray, bit: int, p: np.ndarray, known: np.ndarray) -> np.ndarray:
        bits = (1 << bit) | (byte >> (8 - bit))
        for d, at in ((1, last << 8 | bits), (0, bits)):
            p, known = mixed(p, known, *(t[at] for t in self.tables[d]))
        return p


def roots(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node at depth 1, zeros, ones, sum of its children's weights) as far as these keys go."""
    all_levels, out = levels(keys, n, 2), []
    for bit in range(8):
        for below, level in zip([None, *all_levels], all_levels, strict=False):
            level.decide(bit, below)
        top = all_levels[-1]
        prefix = top.keys[top.first] >> U64(8 - bit)
        # A node is its context's byte and its bits so far behind a one: (last byte, second, bits).
        node = ((top.keys[top.first] >> U64(16)) << U64(8) | U64(1 << bit) | (prefix & U64((1 << bit) - 1))).astype(np.int64)
        ids, at = np.unique(node, return_inverse=True)
        out.append((ids, *(np.bincount(at, x, len(ids)) for x in (top.zeros, top.ones, top.weight))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def log10_of(keys: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """Log10 probability of each key's byte in its context; keys hold whole two-byte contexts."""
    all_levels = levels(keys, n, 2)
    places = [np.arange(len(keys))]
    for level in all_levels[:-1]:
        places.append(level.up[places[-1]])
    byte, last = (keys & U64(0xFF)).astype(np.int64), (keys >> U64(8 * DEPTH)).astype(np.int64)
    total = np.zeros(len(keys))
    for bit in range(8):
        p, known = np.full(len(keys), 0.5), np.zeros(len(keys), bool)
        for below, level, place in zip([None, *all_levels], all_levels, places, strict=False):
            level.decide(bit, below)
            at = level.node[place]
            p, known = mixed(p, known, level.zeros[at], level.ones[at], level.odds[at])
        p = top.mix(byte, last, bit, p, known)
        total += np.log10(np.where((byte >> (7 - bit)) & 1, p, 1 - p))
    return total


def _whole_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted (key, n) in runs that end where the last two bytes of context change."""
    keys, n, size = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys.append(b.column("key").to_numpy().view(U64))
        n.append(b.column("n").to_numpy())
        size += b.num_rows
        if size >= TREE_KEYS:
            k, c = np.concatenate(keys), np.concatenate(n)
            cut = int(np.searchsorted(k >> U64(32), k[-1] >> U64(32)))
            if cut:
                yield k[:cut], c[:cut]
            keys, n, size = [k[cut:]], [c[cut:]], len(k) - cut
    if size:
        yield np.concatenate(keys), np.concatenate(n)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, n in _whole_contexts(batches):
        node, zeros, ones, below = roots(keys, n)
        yield _batch("node int, zeros double, ones double, below double", len(node), node=node, zeros=zeros, ones=ones, below=below)


_ANSWERS = "kind int, piece int, keys binary, answers binary"


def _answers(batches: Iterator[pa.RecordBatch], top: Top, pieces: int) -> Iterator[pa.RecordBatch]:
    for keys, n in _whole_contexts(batches):
        for p, k, value in by_piece(pieces, keys, log10_of(keys, n, top)):
            yield _batch(_ANSWERS, 1, kind=GRAM, piece=p, keys=[packed_keys(k)], answers=[planes(value)])


_REPLIES = "kind int, part int, seq int, piece int, texts binary, ids binary, sizes binary, answers binary"


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For sorted rows (kind, piece, answers first): the answers to each group's keys, in their order."""
    of, parts, keys, answers = None, [], None, None
    for b in batches:
        for kind, piece, part, seq, k, a in zip(*(b.column(c).to_pylist() for c in ("kind", "piece", "part", "seq", "keys", "answers")), strict=True):
            if of != (kind, piece):
                of, parts, keys = (kind, piece), [], None
            if a is not None:
                parts.append((unpacked_keys(k), unplanes(a, float)))
                continue
            if keys is None:
                keys, answers = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(keys)
                keys, answers, parts = keys[order], answers[order], []
            got = answers[np.searchsorted(keys, unpacked_keys(k))]
            yield _batch(_REPLIES, 1, kind=kind, part=part, seq=seq, piece=piece, answers=[planes(got if kind == WORD else got.astype(np.float32))])


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, log_known double, n_bytes long, score double"


def _score(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """For rows sorted by group: each text's sums. A group's keys are found again, in the order of its questions."""
    of, texts, told = None, [], {}

    def finished():
        tallies = {WORD: Tally(), GRAM: Tally()}
        for row in texts:
            _, own = _unpacked(*row)
            _tally(tallies, own, np.zeros(len(own), bool))
        known = {}
        for kind, tally in tallies.items():
            parts = [(k, unplanes(told[kind, p], float if kind == WORD else np.float32)) for p, k in by_piece(pieces, tally.sum()[0])]
            if parts:
                known[kind] = Answers(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for row in texts:
            yield _scored(*_unpacked(*row), known)

    for b in batches:
        for kind, part, seq, piece, answers, *row in zip(*(b.column(c).to_pylist() for c in ("kind", "part", "seq", "piece", "answers", "texts", "ids", "sizes")), strict=True):
            if of != (part, seq):
                if texts:
                    yield from finished()
                of, texts, told = (part, seq), [], {}
            if kind == TEXT:
                texts.append(row)
            else:
                told[kind, piece] = answers
    if texts:
        yield from finished()


def _scored(ids: list, texts: list[bytes], known: dict[int, Answers]) -> pa.RecordBatch:
    n = len(texts)
    score, n_tokens, n_known, logs = np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    for owner, before, body in stretches(texts):
        code, first = codes(before, body)
        np.add.at(score, owner, np.add.reduceat(known[GRAM](code).astype(float), first[:-1]))
    at = 0
    for group in kernels.grouped(texts):
        words, first = kernels.words(group)
        here = slice(at, at + len(group))
        at += len(group)
        n_tokens[here] += np.diff(first)
        if len(words):
            count = known[WORD](words)
            for out, value in ((n_known, count > 0), (logs, np.log10(count + 0.1))):
                sums = np.concatenate([np.zeros(1, value.dtype if value.dtype != bool else np.int64), np.cumsum(value)])
                out[here] += sums[first[1:]] - sums[first[:-1]]
    held = np.array([held_out(i) for i in ids])
    return _batch(_SCORED, n, doc_id=ids, held_out=held, n_tokens=n_tokens, n_known=n_known, log_known=logs, n_bytes=np.array([len(t) for t in texts]), score=score)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every document.

    bits_per_byte is the code length of a text's bytes and its end for each of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    pieces = pieces_for(size)
    asked = written(docs.mapInArrow(lambda b: _ask(b, pieces), _ASKED), "asked", "zstd")
    keys = asked.where(F.col("kind") < TEXT)
    n_keys, parts, groups, texts = asked.agg(
        F.sum(F.when(F.col("kind") < TEXT, F.col("n"))), F.max("part"), F.max("seq"), F.coalesce(F.sum(F.when(F.col("kind") == TEXT, F.col("n"))), F.lit(0)),
    ).first()
    n_keys, parts, groups = n_keys or 0, (0 if parts is None else parts) + 1, (groups or 0) + 1
    counted = written(keys.select("kind", "piece", "keys", "counts").repartitionById(2 * pieces, F.expr("piece * 2 + kind")).mapInArrow(_count, _COUNTED), "counted")
    tokens, distinct, n_grams = counted.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0)), F.count("key")).first()
    tokens, distinct = tokens + texts, distinct + (texts > 0)  # with the end token

    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_grams // (4 * TREE_KEYS))
    grams = counted.where(F.col("kind") == GRAM).select("key", "n").repartition(deal, F.shiftright("key", 32)).sortWithinPartitions("key")
    sums = grams.mapInArrow(_roots, "node int, zeros double, ones double, below double").groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow()
    top = Top(*(sums.column(i).to_numpy() for i in range(4)))

    # Answers are copied to as many tasks as one piece's questions need.
    copies = int(max(1, n_keys // (pieces * ANSWERED)))
    answers = grams.mapInArrow(lambda b: _answers(b, top, pieces), _ANSWERS).unionByName(counted.where(F.col("kind") == WORD).select("kind", "piece", "keys", F.col("counts").alias("answers")))
    answers = answers.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    questions = keys.select("kind", "piece", "part", "seq", "keys", F.expr(f"pmod(part + seq, {copies})").cast("int").alias("copy"))
    both = questions.unionByName(answers, allowMissingColumns=True).repartitionById(pieces * copies, F.expr(f"piece * {copies} + copy"))
    replies = both.sortWithinPartitions("kind", "piece", F.col("answers").isNull()).mapInArrow(_reply, _REPLIES)

    told = replies.unionByName(asked.where(F.col("kind") == TEXT).select("kind", "part", "seq", "texts", "ids", "sizes"), allowMissingColumns=True)
    told = told.repartitionById(parts * groups, F.expr(f"seq * {parts} + part")).sortWithinPartitions("seq", "part")
    out = told.mapInArrow(lambda b: _score(b, pieces), _SCORED)
    base = F.col("log_known") + F.lit(math.log10(texts + 0.1)) - F.col("n_tokens") * F.lit(math.log10(tokens + 0.1 * (distinct + 1)))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(texts > 0))).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score", (-F.col("score") * F.lit(math.log2(10)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
