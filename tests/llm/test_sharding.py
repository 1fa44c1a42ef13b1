import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from rasterlake.llm import sharding


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(spark, n, bits):
    cells = spark.createDataFrame(list(product(range(1 << bits), repeat=n)), ", ".join(f"__x{i} int" for i in range(n)))
    kept = cells.select("*", *(F.col(f"__x{i}").alias(f"c{i}") for i in range(n)))
    got = sorted((r["__hilbert"], tuple(r[f"c{i}"] for i in range(n))) for r in sharding.with_hilbert_index(kept, n, bits).collect())
    assert [h for h, _ in got] == list(range(1 << (n * bits)))
    for (_, a), (_, b) in zip(got, got[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_rows_law(docs, rows):
    got = sharding.shard_documents(docs).collect()
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_bytes_law(spark):
    df = spark.createDataFrame([(i, "x" * (i % 17), "en", f"s{i % 3}") for i in range(900)], "doc_id long, text string, lang string, source string")
    got = sharding.shard_documents(df, law="bytes").collect()
    sums = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert max(sums) - min(sums) <= 2 * 17
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(v == list(range(len(v))) for v in by.values())


def test_shards_are_small_boxes(spark):
    df = spark.createDataFrame([(i, "x" * (37 * i % 500), "en", f"s{i * 7 % 16}") for i in range(2000)], "doc_id long, text string, lang string, source string")
    shards = sharding.shard_documents(df, 16).select("doc_id", "shard")
    stats = sharding.pruning_stats(df.join(shards, "doc_id").withColumn("len", F.length("text")), ["doc_id", "len", "source"]).collect()
    for c, v in (("doc_id", 1000), ("len", 250), ("source", "s3")):
        assert sum(s[f"min_{c}"] <= v <= s[f"max_{c}"] for s in stats) <= 12


def test_empty_one_row_and_clashing_names(spark, empty, docs, clashing):
    assert sharding.shard_documents(empty).count() == 0
    one = spark.createDataFrame([(None, None, None, None)], "doc_id long, text string, lang string, source string")
    assert [(r.size, r.shard, r.slot) for r in sharding.shard_documents(one).collect()] == [(1, 0, 0)]
    assert sharding.shard_documents(clashing).count() == docs.count()


def test_levels_and_order_equal_brute_force(spark, rows):
    """Each shard is a run of the curve's cells, which follow from quantiles and from shares of strings."""
    prefix = "a common start of more than seven bytes/"
    own = [(r[0], r[1], r[2], None if r[3] is None else prefix + r[3]) for r in rows]
    df = spark.createDataFrame(own, "doc_id long, text string, lang string, source string")
    low = lambda x: (x is not None, x)

    def cuts(values):
        v = sorted(x for x in values if x is not None)
        return sorted({v[max(-(-i * len(v) // 16) - 1, 0)] for i in range(1, 16)})

    def strings(values):
        return {x: 16 * sum(low(y) < low(x) for y in values) // len(values) for x in set(values)}

    source, lang = strings([r[3] for r in own]), strings([r[2] for r in own])
    assert len(set(source.values())) > 3
    lengths, ids = cuts([len(r[1] or "") for r in own]), cuts([r[0] for r in own])
    level = lambda x, c: sum(x > y for y in c) if x is not None else 0
    after, digit = sharding.hilbert_tables(4)

    def place(r):
        x = (source[r[3]], lang[r[2]], level(len(r[1] or ""), lengths), level(r[0], ids))
        state = index = 0
        for b in reversed(range(sharding.BITS)):
            at = state * 16 + sum((x[i] >> b & 1) << i for i in range(4))
            index, state = index * 16 + digit[at], after[at]
        return index

    cells = {}
    for r in own:
        cells.setdefault((r[0], zlib.crc32((r[1] or "").encode())), []).append(place(r))
    got = sorted(sharding.shard_documents(df).collect(), key=lambda r: (r.shard, r.slot))
    order = [cells[r.doc_id, r.text_crc32] for r in got]
    assert all(max(a) >= min(b) or a <= b for a, b in zip(order, order[1:], strict=False))
    certain = [c[0] for c in order if len(set(c)) == 1]
    assert certain == sorted(certain) and len(certain) > len(order) * 0.8
