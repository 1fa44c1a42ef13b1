import hashlib
import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_jaccard_join import brute as brute_components
from test_line_templates import brute as brute_lines
from test_mixing import targets
from test_quality import counts

from rasterlake.llm import packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(random_prose):
    rng = random.Random(31)
    line = "this passage stands in many of the documents and comes back " + random_prose(rng, 45)
    out = []
    for i in range(40):
        t = "\n".join(random_prose(rng, rng.randint(20, 90)) + "." for _ in range(rng.randint(2, 5)))
        out.append((i, t + ("\n" + line if i % 5 == 0 else "")))
    out += [(50 + k, out[k][1]) for k in range(3)]  # copies
    for k in range(4):  # near copies, as one long line each
        words = random_prose(random.Random(9), 300).split()
        words[7 * k] = "changed"
        out.append((60 + k, " ".join(words)))
    out += [(70, "buy this now " * 40), (71, "short"), (72, None), (73, ""), (74, " ".join(["###" + w for w in random_prose(rng, 80).split()]))]
    return [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t or "")) for i, t in out]


def fails(text):
    n, chars, symbols, _, repeats = counts(text)
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    letters = sum(any(c.isalpha() for c in w) for w in words)
    capitals = sum(len(w) > 2 and w[:3].isupper() and w[:3].isalpha() for w in words)
    return n < 50 or 100 * repeats > 50 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > n or 10 * (len(lines) - len(set(lines))) > 4 * len(lines) or 10 * letters < 7 * n or 10 * capitals > 4 * n


def brute(rows):
    kept = [r for r in rows if not fails(r[1])]
    clean = dict(brute_lines([(r[0], r[1]) for r in kept]))
    kept = [(*r[:1], clean[r[0]], *r[2:]) for r in kept if clean[r[0]] == r[1] or WORD.search(clean[r[0]])]
    least = {i: c for i, _, c in brute_components([(r[0], r[1]) for r in kept], 5, 80, 100)}
    kept = [r for r in kept if least[r[0]] == r[0]]
    size, by = {r[0]: len(WORD.findall(r[1])) for r in kept}, defaultdict(int)
    for r in kept:
        by[r[3]] += size[r[0]]
    want, out = targets(by), []
    key = lambda i: hashlib.md5(f"17:{i}".encode()).hexdigest()
    for source in by:
        whole = int(want[source] // by[source])
        more, before = want[source] - whole * by[source], 0
        for r in sorted((r for r in kept if r[3] == source), key=lambda r: key(r[0])):
            extra = before + size[r[0]] / 2 <= more
            before += size[r[0]]
            out += [r] * min(whole + extra, 3)
    encode, pieces = packing.encoder(), []
    for r in out:
        ids = np.array([*encode(r[1]), 0], "<u4")
        pieces += [(r[0], i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(packing.cut(len(ids)))]
    return sorted(pieces)


def test_run_equals_brute_force(spark, corpus, tmp_path):
    spark.createDataFrame(corpus, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(corpus)
    assert sorted(tuple(r)[:5] for r in got) == want
    ids = {w[0] for w in want}
    assert ids & {60, 61, 62, 63} == {60} and not ids & {50, 51, 52, 70, 71, 72, 73, 74}
    fill = defaultdict(list)
    for r in got:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        assert sum(n for _, n in parts) <= 2048 and sorted(parts)[0][0] == 0


def test_stages_keep_columns_and_take_hard_cases(spark, docs, clashing, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mixing", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, clashing, empty):
            out = stage(spark, df, "")
            assert out.columns == list(corpus_pipeline.COLUMNS)
            assert out.count() <= 3 * df.count()


def test_stages_give_hard_rows_their_results(spark, docs, rows, empty, clashing):
    """Nulls, empty texts, repeated rows and rows without an id, stage by stage as the module states."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    kept = corpus_pipeline.quality_rules(spark, docs, "").collect()
    want = sorted((str(r[0]), r[1]) for r in rows if not fails(r[1]))
    assert sorted((str(r.doc_id), r.text) for r in kept) == want
    lines = {(str(r.doc_id), r.text) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert {("100", None), ("101", ""), ("102", " \n\t "), ("None", None), ("None", rows[0][1]), ("0", rows[0][1])} <= lines
    mixed = corpus_pipeline.mix(spark, docs, "")
    # A source without words takes no words, and its documents once each.
    assert mixed.where("doc_id = 101").count() <= 3 and mixed.where("source is null").count() == sum(r[3] is None for r in rows)
    for df in (docs, clashing):
        pieces = corpus_pipeline.pack(spark, df, "").collect()
        assert {str(r.doc_id) for r in pieces} == {str(r[0]) for r in rows}
        assert sorted(r.length for r in pieces if r.doc_id in (100, 101)) == [1, 1]
        assert sum(r.start == 0 for r in pieces) == len(rows)


def test_near_duplicates_keep_other_texts_of_a_repeated_id(spark, random_prose):
    rng = random.Random(8)
    a, b, c = (random_prose(rng, 90) for _ in range(3))
    rows = [(3, a), (104, a), (104, b), (None, c), (None, c), (None, a), (105, None), (105, None), (106, "")]
    df = spark.createDataFrame([(i, t, "en", "src0", 1) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(3, a), (104, b), (None, c), (105, None), (105, None), (106, "")], key=str)


def test_line_dedup_keeps_own_words_of_documents_that_lose_most(spark, random_prose):
    rng = random.Random(6)
    shared, own = [random_prose(rng, 40) for _ in range(9)], "a few words of its own that recur nowhere else"
    rows = [(1, "\n".join(shared)), (2, "\n".join([*shared, own])), (3, "\n".join(shared)), (4, "\n".join([*shared, " ", ""]))]
    df = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, "").collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (own, len(own))}


def test_no_task_of_line_dedup_feeds_two_python_workers(spark, monkeypatch, corpus):
    from rasterlake.llm import line_templates

    def workers(plan):
        """Python nodes of a stage; those below an exchange are others' tasks, and a union's branches are different tasks."""
        if plan.nodeName() == "AdaptiveSparkPlan":
            return workers(plan.executedPlan())
        below = [workers(plan.children().apply(i)) for i in range(plan.children().size())]
        found.append(max(below, default=0))
        total = max(below, default=0) if plan.nodeName() == "Union" else 0 if "Exchange" in plan.nodeName() else sum(below)
        return total + (plan.nodeName() in ("ArrowEvalPython", "MapInArrow"))

    def noted(df, name, *more, write=line_templates.written):
        found.append(workers(df._jdf.queryExecution().executedPlan()))
        return write(df, name, *more)

    found = []
    monkeypatch.setattr(line_templates, "written", noted)
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(corpus, SCHEMA), "")
    found.append(workers(out._jdf.queryExecution().executedPlan()))
    assert max(found) == 1
