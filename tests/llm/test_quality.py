import re
from collections import Counter

from rasterlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    inside = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_counts_equal_brute_force(spark, rows):
    more = [(900, "a b c a b c a b\nx\nx\n\n \n|<>#", "en", "s", 1), (901, "a a a a a", "en", "s", 1), (902, "l\r\nl\r\nl", "en", "s", 1)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(tuple(r)[1:6] for r in quality.quality_report(df).collect())
    assert got == sorted(counts(r[1]) for r in rows + more)


def test_verdicts(spark, random_prose):
    import random

    rng = random.Random(1)
    good = random_prose(rng, 120)
    bad = {"repeats": "buy this now " * 60, "symbols": good.replace(" ", "### "), "min_words": "too short", "letters": " ".join(["1234"] * 40 + good.split()[:50]), "capitals": good.upper(), "dup_lines": "\n".join([random_prose(rng, 8)] * 3 + [random_prose(rng, 60)])}
    df = spark.createDataFrame([(0, good), *((i + 1, t) for i, t in enumerate(bad.values()))], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in quality.quality_report(df).collect()}
    assert kept == {0: True, **{i + 1: False for i in range(len(bad))}}


def test_cascade_agrees_with_report_in_any_order(docs, clashing):
    want = {(r.doc_id, r.n_words): r.kept for r in quality.quality_report(docs).collect()}
    for order in (quality.RULES, quality.RULES[::-1]):
        out = quality.cascade(docs, order=order)
        assert out.columns == [*docs.columns, "rejected_by"]
        got = {(r.doc_id, counts(r.text)[0]): r.rejected_by is None for r in out.collect()}
        assert got == want
    assert quality.cascade(clashing).where("rejected_by = 'x'").count() == 0


def test_order_is_by_rejection_per_cost():
    r = quality.RULES
    assert quality.ordered([(r[0], 1.0, 0.1), (r[1], 1.0, 0.5), (r[2], 0.1, 0.2)]) == (r[2], r[1], r[0])


def test_empty_table(empty):
    assert quality.quality_report(empty).count() == 0 and quality.cascade(empty).count() == 0
