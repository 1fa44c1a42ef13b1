import hashlib
import re

import numpy as np
import pytest

from rasterlake.llm import fingerprints as fp
from rasterlake.llm import kernels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_kernel_counts_shingles(rows):
    texts = [r[1] or "" for r in rows] + ["", "A", "a B  c\x0bd\x1fe f", "é ü x y z w"]
    sets = list(kernels.shingle_sets((t.encode() for t in texts), 5))
    assert [len(s) for s in sets] == [len(shingles(t, 5)) for t in texts]


def test_edited_texts_follow_the_order(docs, rows):
    got = fp.edited_fingerprints(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = []
    for i, (doc_id, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        want.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r in got:
        by_text.setdefault(next(t for i, t in order if i == r.doc_id and len(t) == r.n_chars), set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_likenesses_of_whole_sketches_equal_brute_force(docs, rows):
    got = fp.edited_fingerprints(docs, 5, 1).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    want = []
    for i, (doc_id, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        a, e, n = (shingles(x, 5) for x in (text, text[: len(text) - half] + nxt[:half], nxt))
        want.append((str(doc_id), len(text), round(like(a, e), 9), round(like(a, n), 9)))
    assert sorted((str(r.doc_id), r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)


def test_sketches_estimate_and_merge(random_prose):
    import random

    rng = random.Random(3)
    a, b = random_prose(rng, 6000), random_prose(rng, 6000)
    part, whole = a, a + " " + b
    s, w, o = fp.sketches([part, whole, b], 5, 8)
    assert fp.containment(s, w) > 0.98
    exact = len(shingles(part, 5) & shingles(whole, 5)) / len(shingles(part, 5) | shingles(whole, 5))
    assert fp.jaccard(s, w) == pytest.approx(exact, abs=0.05)
    assert fp.jaccard(s, o) < 0.02
    assert len(np.setdiff1d(fp.merge(s, o), w)) == 0
    assert (fp.decoded(fp.encoded(s)) == s).all()


def test_short_and_empty_texts_have_defined_sketches():
    e, one, same, other = fp.sketches(["", "one", "One ", "two"], 5, 8)
    assert len(e) == 0 and len(one) == 1
    assert fp.jaccard(one, same) == 1 and fp.jaccard(one, other) == 0 and fp.jaccard(e, e) == 1 and fp.jaccard(e, one) == 0


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert fp.edited_fingerprints(empty).count() == 0
    assert fp.edited_fingerprints(clashing).count() == docs.count()
    assert fp.fingerprints(clashing).where("fingerprint = 'x'").count() == 0
