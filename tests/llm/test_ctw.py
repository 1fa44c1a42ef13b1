import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from rasterlake.llm import ctw, groups

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)}).encode()


def train(rows):
    return [lower(r[1]) for r in rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10]


class Brute:
    """Context-tree weighting by dictionaries and recursion."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for t in texts:
            for context, node, bit in self.steps(t):
                for d in range(ctw.DEPTH + 1):
                    self.n[context[len(context) - d :], node][bit] += 1
                    if d:
                        self.children[context[len(context) - d + 1 :], node].add(context[len(context) - d :])
        self.memo = {}

    @staticmethod
    def steps(text):
        b = bytes(ctw.DEPTH) + text + b"\xff"
        for i in range(ctw.DEPTH, len(b)):
            for j in range(8):
                yield b[i - ctw.DEPTH : i], (1 << j) | (b[i] >> (8 - j)), (b[i] >> (7 - j)) & 1

    def weight(self, context, node):
        """(log weighted, log own, log of children)"""
        if (context, node) not in self.memo:
            a, b = self.n[context, node]
            own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
            if len(context) == ctw.DEPTH:
                self.memo[context, node] = own, own, None
            else:
                below = sum(self.weight(c, node)[0] for c in self.children[context, node])
                hi = max(own, below)
                self.memo[context, node] = hi + math.log(math.exp(own - hi) + math.exp(below - hi)) - math.log(2), own, below
        return self.memo[context, node]

    def score(self, text):
        total = 0.0
        for context, node, bit in self.steps(text):
            p = None
            for d in range(ctw.DEPTH, -1, -1):
                c = context[len(context) - d :]
                if (c, node) not in self.n:
                    continue
                a, b = self.n[c, node]
                est = (b + 0.5) / (a + b + 1)
                _, own, below = self.weight(c, node)
                share = 1.0 if p is None else 1 / (1 + math.exp(-max(-30, min(30, own - below))))
                p = share * est + (1 - share) * (0 if p is None else p)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total


def test_scores_equal_brute_force(spark, docs, rows):
    small = [r for r in rows if not r[1] or len(r[1]) < 3000]
    df = spark.createDataFrame(small, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    texts = train(small)
    model = Brute(texts)
    count = Counter(w for t in texts for w in [*WORD.findall(t), None])
    total, distinct = sum(count.values()), len(count)
    got = sorted(ctw.scores(df).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens))
    want = sorted(small, key=lambda r: (r[0] is None, r[0] or 0, len(WORD.findall(lower(r[1])))))
    assert len(got) == len(want)
    for g, r in list(zip(got, want, strict=True)):
        tokens = [*WORD.findall(lower(r[1])), None]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(tokens), sum(count[t] > 0 for t in tokens), total)
        assert g.base_score == pytest.approx(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens))
        assert g.held_out == (zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 10 == 0)
    for g, r in list(zip(got, want, strict=True))[::4]:
        text = lower(r[1])
        assert g.score == pytest.approx(model.score(text), rel=1e-6)
        assert g.bits_per_byte == pytest.approx(-g.score * math.log2(10) / (len(text) + 1))


def reversed_code(context, byte):
    return int.from_bytes(bytes([*reversed(context), byte]), "big")


def test_bytes_of_a_context_sum_to_one(rows):
    import numpy as np

    texts = train([r for r in rows if not r[1] or len(r[1]) < 3000])
    own, n = np.unique(np.concatenate([ctw.codes(b, t)[0] for _, b, t in ctw.stretches(texts)]), return_counts=True)
    rng = random.Random(4)
    contexts = [bytes(ctw.DEPTH), *(rng.randbytes(ctw.DEPTH) for _ in range(5)), *((int(k) >> 8).to_bytes(ctw.DEPTH, "big")[::-1] for k in rng.sample(own.tolist(), 20))]
    asked = np.array([reversed_code(c, b) for c in contexts for b in range(256)], np.uint64)
    keys, counts = groups.summed([(own, n), (asked, np.zeros(len(asked), np.int64))])
    got = dict(zip(keys.tolist(), ctw.log10_of(keys, counts, ctw.Top(*ctw.roots(keys, counts))), strict=True))
    for c in contexts:
        assert sum(10 ** got[reversed_code(c, b)] for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_subtrees_do_not_depend_on_how_keys_are_dealt(rows):
    import numpy as np
    import pyarrow as pa

    texts = train([r for r in rows if not r[1] or len(r[1]) < 3000])
    keys, n = np.unique(np.concatenate([ctw.codes(b, t)[0] for _, b, t in ctw.stretches(texts)]), return_counts=True)
    top = ctw.Top(*ctw.roots(keys, n))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7].view(np.int64)), pa.array(n[i : i + 7])], ["key", "n"]) for i in range(0, len(keys), 7)]
    old, ctw.TREE_KEYS = ctw.TREE_KEYS, 50
    try:
        runs = list(ctw._whole_contexts(iter(batches)))
    finally:
        ctw.TREE_KEYS = old
    assert len(runs) > 5 and np.array_equal(np.concatenate([k for k, _ in runs]), keys)
    assert np.allclose(np.concatenate([ctw.log10_of(k, c, top) for k, c in runs]), ctw.log10_of(keys, n, top))


def test_long_texts_are_cut_with_their_context():
    import numpy as np

    from rasterlake.llm import kernels

    rng = random.Random(1)
    texts = [b"".join(rng.choice([b"a", b"B", b" ", b"\n", b"long"]) for _ in range(n)) for n in (0, 1, 40, 700)]
    whole = [ctw.codes([bytes(ctw.DEPTH)], [t + ctw.END])[0] for t in texts]
    got = [[] for _ in texts]
    for owner, before, body in ctw.stretches(texts, 16):
        code, first = ctw.codes(before, body)
        for i, a, b in zip(owner, first[:-1], first[1:], strict=True):
            got[i].append(code[a:b])
    assert all(np.array_equal(np.concatenate(g), w) for g, w in zip(got, whole, strict=True))
    for most in (1, 2, 5, 64):
        for t in texts:
            pieces = list(kernels.cut_text(t, most))
            assert b"".join(p for p, _ in pieces) == t
            assert [w for p, long in pieces for w in ([p] if long else WORD.findall(p))] == WORD.findall(t)
            assert all(long == (len(w) >= most) for p, long in pieces for w in ([p] if long else WORD.findall(p)))


def test_a_text_of_many_megabytes(spark, random_prose):
    line = random_prose(random.Random(3), 2000)
    text = (line + "\n") * (3_000_000 // len(line)) + "x" * 2_000_000
    got = {r.doc_id: r for r in ctw.scores(spark.createDataFrame([(1, text), (2, text), (3, line)], "doc_id long, text string")).collect()}
    assert got[1].n_tokens == got[1].n_known == len(text.split()) + 1 and got[1].score == got[2].score
    assert -1e6 < got[1].score < 0


def test_planes():
    import numpy as np

    rng = np.random.default_rng(0)
    for size in (0, 1, 1000):
        keys = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        assert np.array_equal(ctw.unpacked_keys(ctw.packed_keys(keys)), keys)
        got = {}
        for p, k, v in ctw.by_piece(7, keys, keys + np.uint64(1)):
            assert np.array_equal(k + np.uint64(1), v)
            got[p] = k
        assert sorted(x for k in got.values() for x in k) == keys.tolist()


def test_log_gamma():
    import numpy as np

    x = np.array([0.5, 1, 1.5, 2, 9.5, 10, 1e3, 1e9])
    assert ctw.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert ctw.scores(empty).count() == 0
    assert ctw.scores(clashing).count() == docs.count()


def test_without_training_texts(spark):
    held = next(i for i in range(100) if ctw.held_out(i))
    row = ctw.scores(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0)
    assert row.score == pytest.approx(24 * math.log10(0.5))
