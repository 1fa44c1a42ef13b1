import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pytest

from rasterlake.llm import packing


def lay(runs, n):
    """Fills sequences from runs; fails where two pieces overlap."""
    used = defaultdict(list)
    ranks = defaultdict(list)
    for length, a, b, at, offset in runs:
        for r in range(a, b):
            used[at + r - a].append((offset, length))
            ranks[length].append(r)
    assert not used or (min(used) >= 0 and max(used) < n)
    for parts in used.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= packing.CAPACITY
    return {k: sorted(v) for k, v in ranks.items()}


def best_fit_decreasing(lengths):
    """Sequences that plain best fit uses, one piece at a time."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(gaps, x)
        n += i == len(gaps)
        insort(gaps, (gaps.pop(i) if i < len(gaps) else packing.CAPACITY) - x)
    return n


@pytest.mark.parametrize("kind", ["uniform", "large", "hot", "few", "none"])
def test_plan_places_every_piece_once(kind):
    rng = random.Random(kind)
    lengths = {"uniform": [rng.randint(1, 2048) for _ in range(4000)], "large": [rng.randint(700, 1400) for _ in range(3000)], "hot": [512] * 4000 + [rng.randint(1, 2048) for _ in range(500)], "few": [2048, 1, 1025], "none": []}[kind]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs, n = packing.plan(dict(counts))
    assert lay(runs, n) == {k: list(range(v)) for k, v in counts.items()}
    assert n <= 1.015 * best_fit_decreasing(lengths) + 1


def test_patterns_reach_the_optimum():
    # three of 600 fill as well as one of 1200 and one of 800: 60 / 3 + 50 / 1
    found = packing.patterns(np.array([1200, 800, 600]), np.array([50.0, 50.0, 60.0]), 2048)
    assert sum(x for _, x in found) == pytest.approx(70)
    rng = random.Random(9)
    for _ in range(50):
        sizes = np.array(rng.sample(range(410, 2048), 12))
        values = np.array([rng.choice([0, rng.random(), s / 2048]) for s in sizes])
        value, taken = packing.Knapsack(sizes, 2048).best(values)
        best = [0.0] * 2049
        for c in range(2049):
            best[c] = max([0.0, *(best[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
        assert value == pytest.approx(best[2048]) == pytest.approx((taken * values).sum()) and (taken * sizes).sum() <= 2048


def test_fast_ids_equal_those_of_the_tokenizer():
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    plain = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028))]
    texts = ["".join(rng.choice(plain) for _ in range(rng.randint(0, 300))) for _ in range(300)]
    texts += [f"a{c}b {c}1" for c in plain] + ["", "<|endoftext|> x", "a<|endoftext|>", "<|end", "1 <| 2 |>", "  \n\n  a   b ", "漢字 🙂", " x\x1c y", "x" * 5000, " " * 5000, "it's we'll I'D"]
    encode = packing.encoder()
    assert [encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_fast_ids_equal_those_of_the_tokenizer_on_a_whole_table(spark):
    import public_tokenizers as public
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encode(text) == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_keep_their_ids(spark):
    row = packing.packed_documents(spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string")).first()
    assert (row.length, row.ids_crc32) == (2, zlib.crc32(np.array([50256, 0], "<u4").tobytes()))


def test_documents_come_back(spark, docs, rows):
    got = packing.packed_documents(docs).collect()
    encode = packing.encoder()
    want = sorted(((r[0], i, s, n, zlib.crc32(np.array([*encode(r[1] or ""), 0], "<u4")[s : s + n].tobytes())) for r in rows for i, (s, n) in enumerate(packing.cut(len(encode(r[1] or "")) + 1))), key=str)
    assert sorted((tuple(r)[:5] for r in got), key=str) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        place = 0
        for offset, length in sorted(parts):
            assert offset == place
            place += length
        assert place <= 2048
    assert len(by) <= 1.05 * sum(r.length for r in got) / 2048 + 2


def test_cut_puts_the_shorter_piece_first():
    assert packing.cut(1) == [(0, 1)] and packing.cut(2048) == [(0, 2048)]
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert packing.packed_documents(empty).count() == 0
    assert packing.packed_documents(clashing).count() == packing.packed_documents(docs).count()
