import hashlib
import re
from collections import defaultdict

import pytest

from rasterlake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(5, 2, 1), epochs=3):
    """By the words of the contract: clamp and share again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > epochs * sizes[s]]
        if not over:
            return {s: epochs * sizes[s] if s in full else share[s] for s in order}
        full |= set(over)
        left = sum(sizes.values()) - sum(epochs * sizes[s] for s in full)


def test_targets_and_takings(docs, rows):
    size = lambda r: len(WORD.findall(r[1] or ""))
    sizes, largest = defaultdict(int), defaultdict(int)
    by_id = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r)
        by_id[r[3], r[0]] += size(r)
        largest[r[3]] = max(largest[r[3]], by_id[r[3], r[0]])
    want, got = targets(sizes), mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    source = defaultdict(set)
    for r in rows:
        source[r[0], size(r)].add(r[3])
    for g in got:
        assert 0 <= g.taken <= 3 * g.size and g.taken == g.size * g.copies
        own = [s for s in source[g.doc_id, g.size] if sizes[s] == g.source_size]
        assert g.target == pytest.approx(want[own[0]])
        taken[own[0]] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(docs):
    key = lambda r: str(tuple(r))
    assert sorted(mixing.mixture(docs).collect(), key=key) == sorted(mixing.mixture(docs.repartition(9)).collect(), key=key)


def test_mixed_repeats_documents(docs, clashing):
    from collections import Counter

    want = Counter()
    for r in mixing.mixture(docs).collect():
        want[r.doc_id] += r.copies
    got = Counter(r.doc_id for r in mixing.mixed(docs).select("doc_id").collect())
    assert got == +want
    assert mixing.mixed(clashing).columns == clashing.columns and mixing.mixed(clashing).count() == sum(want.values())


def test_many_sources_take_the_join(spark, docs, monkeypatch):
    from rasterlake.llm import common

    key = lambda r: str(tuple(r))
    want = sorted(mixing.mixture(docs).collect(), key=key)
    few = common.with_small
    monkeypatch.setattr(mixing, "with_small", lambda df, small, on: few(df, small, on, most=1))
    assert sorted(mixing.mixture(docs).collect(), key=key) == want


def test_one_source_and_no_words(spark, empty):
    assert mixing.mixture(empty).count() == 0
    out = mixing.mixture(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.size, r.target, r.taken) for r in out] == [(0, 0.0, 0)] * 2
    out = mixing.mixture(spark.createDataFrame([(1, "a b", "a"), (2, "c", "a")], "doc_id long, text string, source string")).collect()
    assert sum(r.taken for r in out) == 3 and all(r.target == 3.0 for r in out)


def test_key_is_a_digest(docs):
    r = mixing.sized(docs.where("doc_id = 1")).first()
    assert r.key == hashlib.md5(b"17:1").hexdigest()
