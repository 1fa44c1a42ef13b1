"""Operator 4: line dedup by a log-template tree.

Every line is parsed down a tree of fixed depth: by its number of tokens, then by its first
`lead` tokens, where a token with a digit counts as a variable field. In a leaf, lines generalise
to templates: the line with its variable fields masked, and for lines long enough the two forms in
which one half of the rest is masked as well, so that two lines of a leaf are of one template when
they agree in the other half. Templates are counted by hash over all documents, with partial counts
before the shuffle; there is no pairwise comparison, so that a leaf of any size is shared by tasks.

Every line that is not blank is also counted as it stands, word by word, and recurs if two documents
have it. Masked forms are held more strictly: one with at least `strong` constant tokens recurs if two
documents have it, one with fewer (but `least`) needs `masked` occurrences in two or more documents.
Recurring lines are dropped from all documents but the one with the smallest doc_id that has the
template; lines repeated within one document stay.

Passages inside lines, or broken into lines differently, are found in what is left: stretches of
`passage` words or more that two documents have word by word. Every window of that many words has an
anchor, the least hash of its runs of `GRAM` words, which only the window's own words decide. Windows
whose anchor stands in one document alone can't recur; the others are counted by hash like lines, and
the words of recurring ones are dropped from all documents but the first that has the window. Blanks
after a dropped stretch go with it, but for the last line break.

Blank lines stay, null texts stay null, rows with a null doc_id are kept as they are, and rows with the
same doc_id count as one document. Texts of any length are read whole; repeated rows lose the same; an
empty table gives an empty table. Other columns pass through, but those that are made are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels
from .common import forget, remove, written
from .groups import GROUP_BYTES, batch, packed_keys, planes, unpacked_keys, unplanes

LEAD, STRONG, LEAST = 4, 8, 3
#: Occurrences that a line as it stands, and a masked form of fewer than STRONG constant tokens, need.
EXACT, MASKED = 2, 50
#: Words of a passage, and of the runs of which the least hash is its anchor.
PASSAGE, GRAM = 50, 8
#: Keys at which a group ends, keys of a piece, and least pieces.
GROUP_KEYS, PIECE_KEYS, LEAST_PIECES = 2 << 20, 1 << 20, 16
U64 = np.uint64
#: What a group asks: its distinct keys in ascending order, the least doc_id of each, how far the largest is from it, and how often it has it.
_ASKS = "part int, seq int, n long, keys binary, least binary, spread binary, times binary"
#: What a group keeps for later: for each of its places, the number of the key; the places by line, or by text and word.
_KEEPS = "owner binary, place binary, number binary, dropped binary"
_DEALT = "part int, seq int, piece int, keys binary, least binary, spread binary, times binary"
_TOLD = "part int, seq int, piece int, asked int, recurs binary, first binary"
MADE = ("n_lines", "n_dropped", "n_passages", "dropped_chars")


def line_keys(word: np.ndarray, fixed: np.ndarray, first: np.ndarray, lead: int = LEAD, strong: int = STRONG, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every template of every line; a key is odd if it needs MASKED occurrences, even if EXACT ones.

    A token's hash is mixed with its place in the line, so that sums over places name a template.
    """
    n = np.diff(first)
    place = np.arange(len(word)) - np.repeat(first[:-1], n)
    turn = (place.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
    field = np.flatnonzero(~fixed)
    own = kernels.mix(word + turn)
    whole = np.concatenate([np.zeros(1, U64), np.cumsum(own, dtype=U64)])
    own[field] = kernels.mix(turn[field])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(own, dtype=U64)])
    count = np.concatenate([np.zeros(1, np.int64), np.cumsum(fixed)])
    a, b = first[:-1], first[1:]
    head = a + np.minimum(lead, n)
    middle = head + np.maximum((n - lead) // 2, 0)
    wide = (n >= least) & (count[b] - count[a] >= least)
    plain = count[b] - count[a] == n
    size = n.astype(U64) * U64(0xD1342543DE82EF95)
    # A line without a digit is its own masked form; that of a strong line stands for the line too.
    own = np.flatnonzero((n > 0) & ~plain & (count[b] - count[a] < strong))
    out = [(own, kernels.mix((whole[b] - whole[a])[own] + size[own] + U64(3)) & ~U64(1))]
    for kind, parts in enumerate((((a, b),), ((a, middle),), ((a, head), (middle, b)))):
        sums, const = np.zeros(len(n), U64), np.zeros(len(n), np.int64)
        for x, y in parts:
            sums += total[y] - total[x]
            const += count[y] - count[x]
        take = np.flatnonzero(wide | (plain & (n > 0)) if kind == 0 else wide & (const >= strong))
        weak = ~((const >= strong) | plain)[take]
        out.append((take, kernels.mix(sums[take] + size[take] + U64(kind)) & ~U64(1) | weak.astype(U64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lines(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, whether it has no digit, the first word of each line and one more) of the texts' lines."""
    if any(len(t) >= kernels.GROUP_BYTES for t in texts):
        return _tokens([x for t in texts for x in t.split(b"\n")])
    joined, start, end, _ = kernels.spans(texts)
    fixed = np.ones(len(start), bool)
    fixed[np.searchsorted(start, np.flatnonzero(joined - np.uint8(48) < 10), "right") - 1] = False
    # Lines end at line breaks and at the blanks between texts.
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    ends = np.sort(np.concatenate([ends, np.flatnonzero(joined == 10)]))
    return kernels.hashed(joined, start, end, lower=False), fixed, np.concatenate([np.zeros(1, np.int64), np.searchsorted(start, ends)])


def _tokens(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, whether it has no digit, each line's first word); long lines are cut between words."""
    word, fixed, n = [], [], []
    for group in kernels.grouped(lines):
        if len(group) > 1 or len(group[0]) < kernels.GROUP_BYTES:
            pieces = [(group, False)]
        else:
            pieces = [([p], long) for p, long in kernels.cut_text(group[0])]
        count = []
        for own, long in pieces:
            if long:
                word.append(kernels.long_word(own[0], False))
                fixed.append(np.array([not re.search(rb"[0-9]", own[0])]))
                count.append(np.ones(1, np.int64))
                continue
            joined, start, end, first = kernels.spans(own)
            digits = np.concatenate([np.zeros(1, np.int64), np.cumsum((joined >= 48) & (joined <= 57))])
            fixed.append(digits[end] == digits[start])
            word.append(kernels.hashed(joined, start, end, lower=False))
            count.append(np.diff(first))
        n.append(count[0] if len(pieces) == 1 and len(group) > 1 else np.array([sum(int(c.sum()) for c in count)]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none.astype(U64), *word]), np.concatenate([none.astype(bool), *fixed]), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([none, *n]))])


def packed(text: str) -> bytes:
    """A text as its length in bytes and zstd, for tables of single texts."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order that sorts the keys, the first of each distinct key in it, each key's number among the distinct ones)."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    number = np.empty(len(own), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order, np.flatnonzero(new), number


def _reduced(how: np.ufunc, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return how.reduceat(values, starts) if len(starts) else values[:0]


def _asked(keys: list[np.ndarray], ids: list[np.ndarray]) -> dict:
    """A group's question about its places' keys, whose documents are ids, and the number of each place's key."""
    key, of = np.concatenate([np.zeros(0, U64), *keys]), np.concatenate([np.zeros(0, np.int64), *ids])
    order, starts, number = _numbered(key)
    of = of[order]
    least = _reduced(np.minimum, of, starts)
    return {
        "n": len(starts),
        "keys": [packed_keys(key[order[starts]])],
        "least": [planes(least)],
        "spread": [planes(_reduced(np.maximum, of, starts) - least)],
        "times": [planes(np.diff(starts, append=len(key)).astype(np.uint32))],
        "number": [planes(number)],
    }


def _deal(batches: Iterator[pa.RecordBatch], pieces: int) -> Iterator[pa.RecordBatch]:
    """Questions by piece. Keys are dealt by ranges, so that answers in the order of pieces are in the order of keys."""
    ends = np.array([(p << 64) // pieces for p in range(1, pieces)], U64)
    for b in batches:
        for part, seq, keys, *values in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "keys", "least", "spread", "times")), strict=True):
            key = unpacked_keys(keys)
            values = [unplanes(raw, kind) for raw, kind in zip(values, (np.int64, np.int64, np.uint32), strict=True)]
            cuts = pairwise([0, *np.searchsorted(key, ends).tolist(), len(key)])
            some = [(p, slice(x, y)) for p, (x, y) in enumerate(cuts) if y > x]
            least, spread, times = ([planes(v[at]) for _, at in some] for v in values)
            yield batch(_DEALT, len(some), part=part, seq=seq, piece=[p for p, _ in some], keys=[packed_keys(key[at]) for _, at in some], least=least, spread=spread, times=times)


def _answer(batches: Iterator[pa.RecordBatch], masked: bool) -> Iterator[pa.RecordBatch]:
    """For all questions of a piece: which keys two documents have (odd ones, if masked, MASKED times), and the first that has each."""
    parts, seqs, pieces, keys, least, most, times = [], [], [], [], [], [], []
    for b in batches:
        parts += b.column("part").to_pylist()
        seqs += b.column("seq").to_pylist()
        pieces += b.column("piece").to_pylist()
        for key, low, spread, n in zip(*(b.column(c).to_pylist() for c in ("keys", "least", "spread", "times")), strict=True):
            keys.append(unpacked_keys(key))
            least.append(unplanes(low, np.int64))
            most.append(least[-1] + unplanes(spread, np.int64))
            times.append(unplanes(n, np.uint32).astype(np.int64))
    if not keys:
        return
    ends = np.cumsum([len(x) for x in keys])
    key = np.concatenate(keys)
    order, starts, number = _numbered(key)
    first, last, n = (_reduced(how, np.concatenate(x)[order], starts) for how, x in ((np.minimum, least), (np.maximum, most), (np.add, times)))
    recurs = first != last
    if masked:
        recurs &= (n >= MASKED) | (key[order[starts]] & U64(1) == 0)
    recurs, first = recurs[number], first[number]
    spans = list(pairwise([0, *ends.tolist()]))
    told = [np.packbits(recurs[x:y]).tobytes() for x, y in spans]
    yield batch(_TOLD, len(spans), part=parts, seq=seqs, piece=pieces, asked=[y - x for x, y in spans], recurs=told, first=[planes(first[x:y][recurs[x:y]]) for x, y in spans])


def _told(asked: DataFrame, masked: bool = False) -> DataFrame:
    """(part, seq, piece, asked, recurs, first): the answers to a table of questions."""
    keys = asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    pieces = max(int(keys) // PIECE_KEYS, LEAST_PIECES)
    dealt = asked.select("part", "seq", "keys", "least", "spread", "times").mapInArrow(lambda b: _deal(b, pieces), _DEALT)
    return dealt.repartitionById(pieces, F.col("piece")).mapInArrow(lambda b: _answer(b, masked), _TOLD)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, dict, np.ndarray, np.ndarray]]:
    """(part, seq, columns, whether each of its keys recurs, and where first) of each group in rows sorted by group."""
    of, held, told = None, {}, {}

    def finished():
        answers = [told[p] for p in sorted(told)]
        told.clear()
        recurs = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) for n, bits, _ in answers)])
        first = np.zeros(len(recurs), np.int64)
        first[recurs] = np.concatenate([np.zeros(0, np.int64), *(unplanes(x, np.int64) for _, _, x in answers)])
        return *of, held, recurs, first

    for b in batches:
        names = b.schema.names
        for row in zip(*(b.column(c).to_pylist() for c in names), strict=True):
            row = dict(zip(names, row, strict=True))
            at = row.pop("part"), row.pop("seq")
            if at != of:
                if of:
                    yield finished()
                of, held = at, {}
            piece, *answer = (row.pop(c) for c in ("piece", "asked", "recurs", "first"))
            if piece is not None:
                told[piece] = answer
            held |= {k: v for k, v in row.items() if v is not None}
        b = row = None
    if of:
        yield finished()


def _blocks(rows: bytes) -> Iterator[pa.RecordBatch]:
    yield from pa.ipc.open_stream(pa.BufferReader(rows))


def _own(block: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray, list[bytes]]:
    """(all texts, the rows that have a doc_id and a text, their doc_ids, their texts)."""
    ids, texts = block.column("__id"), block.column("text").cast(pa.binary()).to_pylist()
    own = np.flatnonzero(np.array([t is not None for t in texts], bool) & ids.is_valid().to_numpy(zero_copy_only=False))
    return texts, own, ids.fill_null(0).to_numpy(zero_copy_only=False)[own], [texts[i] for i in own]


def _ask_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in groups, and what each asks about its lines."""
    part, seq = TaskContext.get().partitionId(), 0
    sink = pack = None
    keys, ids, place, size, held, lines = [], [], [], 0, 0, 0
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1), use_threads=False)

    def group():
        pack.close()
        return batch(f"{_ASKS}, {_KEEPS}, rows binary", 1, part=part, seq=seq, rows=[sink.getvalue().to_pybytes()], place=[planes(np.concatenate([np.zeros(0, np.int32), *place]))], **_asked(keys, ids))

    for b in batches:
        at = 0
        for some in kernels.grouped(t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()):
            block = b.slice(at, len(some))
            at += len(some)
            if pack is None:
                sink = pa.BufferOutputStream()
                pack = pa.ipc.new_stream(sink, b.schema, options=options)
            pack.write_batch(block)
            size += sum(map(len, some)) + 64 * len(some)
            _, _, own, texts = _own(block)
            if texts:
                n = np.array([t.count(b"\n") + 1 for t in texts])
                line, key = line_keys(*_lines(texts))
                keys.append(key)
                ids.append(np.repeat(own, n)[line])
                place.append((line + lines).astype(np.int32))
                lines += int(n.sum())
                held += len(key)
            if size >= GROUP_BYTES or held >= GROUP_KEYS:
                yield group()
                sink = pack = None
                keys, ids, place, size, held, lines, seq = [], [], [], 0, 0, 0, seq + 1
    if pack is not None:
        yield group()


def _without_lines(texts: list[bytes], dropped: np.ndarray, at: int) -> tuple[list[bytes], np.ndarray, int]:
    """(the texts without their dropped lines, how many each loses, the first line after them); theirs begin at line `at`."""
    out, gone = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        n = t.count(b"\n") + 1
        own = dropped[at : at + n]
        at += n
        if own.any():
            gone[i] = own.sum()
            t = b"\n".join(compress(t.split(b"\n"), (~own).tolist()))
        out.append(t)
    return out, gone, at


def _ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each group's dropped lines, and what it asks about the anchors of what is left."""
    for part, seq, held, recurs, first in _groups(batches):
        place, number = unplanes(held["place"], np.int32), unplanes(held["number"], np.int32)
        hit = np.flatnonzero(recurs[number])
        hit = hit[np.argsort(place[hit])]
        place, first = place[hit], first[number[hit]]
        keys, ids, owner, dropped, lines = [], [], [], [], 0
        for block in _blocks(held.pop("rows")):
            _, _, own, texts = _own(block)
            of = np.repeat(own, [t.count(b"\n") + 1 for t in texts])
            some = slice(*np.searchsorted(place, [lines, lines + len(of)]))
            line = place[some] - lines
            drop = np.zeros(len(of), bool)
            drop[line[of[line] != first[some]]] = True
            lines += len(of)
            dropped.append(drop)
            left, _, _ = _without_lines(texts, drop, 0)
            _, starts, anchor, text = _runs(left)
            keys.append(anchor[starts])
            ids.append(own[text[starts]])
            owner.append(np.bincount(text[starts], minlength=len(left)).astype(np.int32))
        none = np.zeros(0, np.int32)
        yield batch(f"{_ASKS}, {_KEEPS}", 1, part=part, seq=seq, owner=[planes(np.concatenate([none, *owner]))], dropped=[np.packbits(np.concatenate([none.astype(bool), *dropped])).tobytes()], **_asked(keys, ids))


def _grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts of all windows of PASSAGE words that lie in one text, their anchors)."""
    n = len(hashes)
    padded = np.concatenate([hashes, np.zeros(PASSAGE, U64)])
    least = kernels.mix(sum((padded[j : j + n] * kernels.turn(j) for j in range(GRAM)), np.zeros(n, U64)))
    width, span = 1, PASSAGE - GRAM + 1
    while width < span:  # least of `width` neighbours
        step = min(width, span - width)
        least = np.minimum(least, np.concatenate([least[step:], np.full(min(step, len(least)), U64(0xFFFFFFFFFFFFFFFF))]))
        width += step
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + PASSAGE <= ends)
    return at, least[at]


def _runs(texts: list[bytes]) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """((word hashes, each text's first, starts of windows), and of the windows: the first of each run of one anchor, their anchors, their texts).

    Anchors are mixed once more: as least hashes they are small, and would all be dealt to the first pieces.
    """
    words, first = kernels.words(texts, lower=False) if texts else (np.zeros(0, U64), np.zeros(1, np.int64))
    at, anchor = _grams(words, first)
    text = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    return (words, first, at), np.flatnonzero(new), kernels.mix(anchor), text


def _ask_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each group asks about the windows whose anchor two documents have."""
    for part, seq, held, recurs, _ in _groups(batches):
        runs, shared = unplanes(held["owner"], np.int32), recurs[unplanes(held["number"], np.int32)]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(runs)])
        any_shared = np.concatenate([np.zeros(1, np.int64), np.cumsum(shared)])
        any_shared = any_shared[ends[1:]] > any_shared[ends[:-1]]
        dropped = np.unpackbits(np.frombuffer(held["dropped"], np.uint8)).astype(bool)
        keys, ids, owner, place, lines, base = [], [], [], [], 0, 0
        for block in _blocks(held.pop("rows")):
            _, _, own, texts = _own(block)
            n = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
            before = lines + np.cumsum(n) - n
            lines += int(n.sum())
            some = np.flatnonzero(any_shared[base : base + len(texts)])
            left = [_without_lines([texts[i]], dropped, before[i])[0][0] for i in some]
            (words, first, at), starts, _, text = _runs(left)
            told = np.concatenate([np.zeros(0, bool), *(shared[ends[base + i] : ends[base + i + 1]] for i in some)])
            take = np.repeat(told, np.diff(starts, append=len(at)))
            at, text = at[take], text[take]
            up, down = kernels.rising(len(words) + 1)
            total = np.concatenate([np.zeros(1, U64), np.cumsum(words * up[: len(words)], dtype=U64)])
            keys.append(kernels.mix((total[at + PASSAGE] - total[at]) * down[at]))
            ids.append(own[some[text]])
            place.append((at - first[text]).astype(np.int32))
            counts = np.zeros(len(texts), np.int32)
            counts[some] = np.bincount(text, minlength=len(some))
            owner.append(counts)
            base += len(texts)
        none = np.zeros(0, np.int32)
        yield batch(f"{_ASKS}, {_KEEPS}", 1, part=part, seq=seq, owner=[planes(np.concatenate([none, *owner]))], place=[planes(np.concatenate([none, *place]))], dropped=[held["dropped"]], **_asked(keys, ids))


_BLANKS = re.compile(rb"[\x20\x09\x0B-\x0D]*")


def without_passages(raw: bytes, starts: np.ndarray) -> tuple[bytes, int]:
    """(the text without the words of the windows that begin at these words, stretches dropped)."""
    _, begin, end, _ = kernels.spans([raw])
    edge = np.zeros(len(begin) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + PASSAGE, -1)
    gone = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    first, last = np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1]) - 1
    out, at = [], 0
    for a, z in zip(begin[first].tolist(), end[last].tolist(), strict=True):
        out.append(raw[at:a])
        at = _BLANKS.match(raw, z).end()
    return b"".join([*out, raw[at:]]), len(first)


def _chars(text: bytes) -> int:
    """Code points: bytes that do not continue one."""
    return int(np.count_nonzero(np.frombuffer(text, np.int8) >= -64))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups' rows without the lines and windows that recur."""
    for _, _, held, recurs, first in _groups(batches):
        windows, place, number = (unplanes(held[c], np.int32) for c in ("owner", "place", "number"))
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(windows)])
        dropped = np.unpackbits(np.frombuffer(held["dropped"], np.uint8)).astype(bool)
        lines = base = 0
        for block in _blocks(held.pop("rows")):
            texts, own, ids, before = _own(block)
            made = {c: np.zeros(len(texts), np.int64) for c in MADE}
            made["n_lines"][:] = [0 if t is None else t.count(b"\n") + 1 for t in texts]
            left, made["n_dropped"][own], lines = _without_lines(before, dropped, lines)
            here = number[ends[base] : ends[base + len(own)]]
            gone = recurs[here] & (first[here] != np.repeat(ids, windows[base : base + len(own)]))
            many = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
            for i, row in enumerate(own.tolist()):
                x, y = ends[base + i] - ends[base], ends[base + i + 1] - ends[base]
                if many[y] > many[x]:
                    left[i], made["n_passages"][row] = without_passages(left[i], place[ends[base] + x : ends[base] + y][gone[x:y]])
                if len(left[i]) < len(before[i]):
                    made["dropped_chars"][row] = _chars(before[i]) - _chars(left[i])
                texts[row] = left[i]
            base += len(own)
            columns = [pa.array(texts, pa.binary()).view(pa.string()) if c == "text" else block.column(c) for c in block.schema.names if c != "__id"]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(made[c]) for c in MADE)], names=[*(c for c in block.schema.names if c != "__id"), *MADE])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with `text` without its recurring lines and passages, and n_lines, n_dropped (lines), n_passages, dropped_chars (code points)."""
    spark = docs.sparkSession
    names = [x for x in docs.columns if x not in MADE]
    own = docs.select(*(F.col(x).cast("string").alias(x) if x == "text" else F.col(x) for x in names), F.col("doc_id").cast("long").alias("__id"))
    schema = T.StructType([*own.schema.fields[:-1], *(T.StructField(x, T.LongType()) for x in MADE)])
    packs = written(own.mapInArrow(_ask_lines, f"{_ASKS}, {_KEEPS}, rows binary"), "packs", "zstd")
    parts, seqs, groups = packs.agg(F.max("part"), F.max("seq"), F.count("part")).first()
    parts, seqs = 1 + (parts or 0), 1 + (seqs or 0)
    tasks = min(parts * seqs, 4 * max(groups, 1))

    def told(keeps: DataFrame, work: Callable, schema, masked: bool = False) -> DataFrame:
        """What work makes of every group, of what it kept and of the answers to what it asked."""
        rows = packs.select("part", "seq", "rows").unionByName(keeps.select("part", "seq", "owner", "place", "number", "dropped"), allowMissingColumns=True)
        rows = rows.unionByName(_told(keeps, masked), allowMissingColumns=True)
        # One group a task, unless a few tasks have made most groups.
        rows = rows.repartitionById(tasks, F.expr(f"int((bigint(seq) * {parts} + part) % {tasks})"))
        return rows.sortWithinPartitions("part", "seq").mapInArrow(work, schema)

    anchors = written(told(packs, _ask_anchors, f"{_ASKS}, {_KEEPS}", masked=True), "anchors", "zstd")
    windows = written(told(anchors, _ask_windows, f"{_ASKS}, {_KEEPS}"), "windows", "zstd")
    remove(spark, anchors)
    # The caller's query shuffles the rows once more.
    forget(spark)
    return told(windows, _apply, schema)
