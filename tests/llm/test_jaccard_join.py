import random
import re

import pytest

from rasterlake.llm import jaccard_join as jj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k, num, den):
    def shingles(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(docs, rows, k, num, den):
    got = sorted((tuple(r) for r in jj.jaccard_components(docs, k, num, den).collect()), key=str)
    assert got == brute(rows, k, num, den)


def test_small_sets_and_a_large_group(spark, random_prose):
    rng = random.Random(8)
    rows = []
    for i in range(40):  # short texts with one word more, less or changed: subsets find them
        words = random_prose(rng, rng.randint(4, 22)).split()
        rows.append((3 * i, " ".join(words)))
        rows.append((3 * i + 1, " ".join([*words, "tail"])))
        words[-1] = "other"
        rows.append((3 * i + 2, " ".join(words)))
    original = random_prose(rng, 150).split()
    for i in range(80):  # a group whose members are linked through one, or not at all
        words = list(original)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(150)] = random_prose(rng, 1) + "x"
        rows.append((1000 + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(df).collect()), key=str)
    assert got == brute(rows, 4, 85, 100)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_longer_and_shorter_copies(spark, k, num, den):
    rng = random.Random(12)
    new = iter(range(10**6))
    fresh = lambda n: [f"w{next(new)}" for _ in range(n)]
    rows = []
    for n in (17, 40, 85, 100, 205, 300, 400):  # sets of n shingles against sets with others added or cut
        for share in (0.05, 0.09, 0.14, 0.17, 0.2, 0.24):
            words, more = fresh(n + k - 1), max(1, int(share * n))
            at = rng.randrange(1, n)
            rows += [words, rng.choice([words + fresh(more), fresh(more) + words, words[more:], words[: -more], words[:at] + fresh(max(1, more - k)) + words[at:]])]
    large = fresh(150)  # and a group whose lists are long
    rows += [large[: 150 - rng.randint(0, 20)] + fresh(rng.randint(0, 20)) for _ in range(60)]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jj.jaccard_components(df, k, num, den).collect()), key=str)
    assert got == brute(rows, k, num, den)


def test_subsets_meet_whenever_sets_link():
    rng = random.Random(2)
    import numpy as np

    for _ in range(300):
        n = rng.randint(1, 12)
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(rng.sample(sorted(a), rng.randint(max(1, n - 2), n))) | {rng.getrandbits(64) for _ in range(rng.randint(0, 1))}
        if len(b) <= 12 and 100 * len(a & b) >= 85 * len(a | b):
            x, y = (set(jj._subsets(np.array(sorted(s), np.uint64), 12, 85, 100)) for s in (a, b))
            assert x & y


def test_sketches_rule_out_no_link(spark):
    import numpy as np

    rng, rows = np.random.default_rng(4), []
    for i in range(400):
        a = rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64)
        keep = a[rng.random(len(a)) < rng.choice([0.3, 0.6, 0.85, 0.9, 0.95, 1])]
        b = np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, 1 + len(a) // 10), dtype=np.uint64)])
        if len(b):
            common = len(np.intersect1d(a, b))
            rows.append((i, len(a), jj.sketch(a), len(b), jj.sketch(b), bool(100 * common >= 85 * (len(a) + len(b) - common))))
    df = spark.createDataFrame(rows, "i int, n_a long, bits_a array<long>, n_b long, bits_b array<long>, links boolean")
    got = df.select("links", jj.may_be_near(85, 100).alias("near")).collect()
    assert all(r.near for r in got if r.links) and sum(r.links for r in got) > 50
    assert sum(r.near for r in got) < 1.5 * sum(r.links for r in got)


def test_boundary_follows_cost():
    cheap = {s: (100, 0.0) for s in range(1, 17)}
    dear = {s: (100, 50.0) for s in range(1, 17)}
    assert jj.best_boundary(cheap, 85, 100) <= jj.best_boundary(dear, 85, 100)
    assert jj.best_boundary({}, 85, 100) == jj.MOST_SMALL


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.label for r in jj.components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert jj.jaccard_components(empty).count() == 0
    key = lambda r: str(tuple(r))
    assert sorted(jj.jaccard_components(clashing).collect(), key=key) == sorted(jj.jaccard_components(docs).collect(), key=key)


def test_a_group_is_signed_in_little_memory(monkeypatch):
    """Tasks hold the keys and counts of a group, 16 MB of text, about once."""
    import tracemalloc

    import pyarrow as pa
    import pyarrow.compute as pc

    rng, one = random.Random(3), type("Task", (), {"partitionId": lambda self: 0})
    monkeypatch.setattr(jj, "TaskContext", type("Context", (), {"get": staticmethod(one)}))
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(150)) for _ in range(4000)]
    texts += [t + " end" for t in texts[:50]]
    size = sum(map(len, texts))
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    of = (5, 80, 100)

    def peak(made):
        tracemalloc.start()
        out = list(made)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return pa.Table.from_batches(out), most / size

    bits = jj.key_bits(size)
    asked, asking = peak(jj._ask(iter([docs]), *of, 16, bits))
    told, _ = peak(jj._total(asked.filter(pc.equal(asked["kind"], jj.KEYS)).to_batches()))
    group = pa.concat_tables([asked.filter(pc.equal(asked["kind"], jj.TEXT)).select(told.column_names[:-1]), told], promote_options="default")
    signed, signing = peak(jj._signatures(iter(group.combine_chunks().to_batches()), of[0], 0, *of[1:], 16, bits))
    assert asked.filter(pc.equal(asked["kind"], jj.ROW)).num_rows == len(texts) and signed.num_rows == 100
    assert asking < 13 and signing < 8, (asking, signing)
