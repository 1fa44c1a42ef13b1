import random
import re
from collections import defaultdict

import numpy as np

from rasterlake.llm import line_templates as lt

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "this very line stands in many of the documents here"


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def brute_lines(rows):
    """Template by template: which documents have it, and what each loses."""
    def keys(line):
        own = line.split()
        t = ["<*>" if any(c in "0123456789" for c in x) else x for x in own]
        const = lambda x: sum(y != "<*>" for y in x)
        out = [(("as it stands", *own), 2)] if own else []
        if len(t) < lt.LEAST or const(t) < lt.LEAST:
            return out
        lead, rest = t[: lt.LEAD], t[lt.LEAD :]
        half = max((len(t) - lt.LEAD) // 2, 0)
        out.append(((0, len(t), *t), 2 if const(t) >= lt.STRONG or t == own else lt.MASKED))
        for kind, part in ((1, rest[:half]), (2, rest[half:])):
            if const(lead) + const(part) >= lt.STRONG:
                out.append(((kind, len(t), *lead, *part), 2))
        return out

    ids, n, needed = defaultdict(set), defaultdict(int), {}
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                for k, need in keys(line):
                    ids[k].add(i)
                    n[k] += 1
                    needed[k] = need
    again = {k: min(v) for k, v in ids.items() if len(v) > 1 and n[k] >= needed[k]}
    return [(i, None if text is None else text if i is None else "\n".join(x for x in text.split("\n") if not any(k in again and again[k] != i for k, _ in keys(x)))) for i, text in rows]


def brute_passages(rows):
    """Window by window: which documents have it, and the words that each loses."""
    words = {k: [(m.start(), m.end(), m[0]) for m in WORD.finditer(t or "")] for k, (_, t) in enumerate(rows)}
    ids = defaultdict(set)
    of = lambda k, j: tuple(w for _, _, w in words[k][j : j + lt.PASSAGE])
    for k, (i, _) in enumerate(rows):
        if i is not None:
            for j in range(len(words[k]) - lt.PASSAGE + 1):
                ids[of(k, j)].add(i)
    out = []
    for k, (i, text) in enumerate(rows):
        gone = set()
        if i is not None:
            for j in range(len(words[k]) - lt.PASSAGE + 1):
                if min(ids[of(k, j)]) != i:
                    gone |= set(range(j, j + lt.PASSAGE))
        left, at = "", 0
        for j in sorted(gone):
            if j - 1 not in gone:
                left += text[at : words[k][j][0]]
            if j + 1 not in gone:
                at = words[k][j][1]
                while at < len(text) and text[at] in " \t\v\f\r":
                    at += 1
        out.append((i, text if not gone else left + text[at:]))
    return out


def brute(rows):
    return sorted(brute_passages(brute_lines(rows)), key=str)


def test_equals_brute_force(spark, docs, rows):
    extra = [(500 + i, f"own {i} words\n{LINE}\nError {i} in module alpha at line {i * 7} of file main dot c") for i in range(5)]
    rows = [(r[0], r[1]) for r in rows] + extra
    got = sorted(((r.doc_id, r.text) for r in lt.dedup_lines(made(spark, rows).repartition(3)).collect()), key=str)
    assert got == brute(rows)


def test_variable_fields_and_halves(spark):
    rows = [(1, "login of user 17 from host 10.0.0.1 was refused at the gate\nsame same\nkeep me"), (2, "login of user 99 from host 10.9.9.9 was refused at the gate\nsame same"), (3, "login of user 5 from host x1 was refused at every other door")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in lt.dedup_lines(made(spark, rows)).collect()}
    assert got[1] == (rows[0][1], 3, 0) and got[2] == ("", 2, 2)
    assert got[3][0] == rows[2][1]  # the halves that differ leave too few constant tokens


def test_one_document_keeps_its_own_repeats_and_blanks(spark):
    rows = [(1, f"{LINE}\n\n{LINE}"), (1, f"{LINE}\n\n{LINE}"), (None, LINE), (2, None), (3, "")]
    got = sorted(((r.doc_id, r.text) for r in lt.dedup_lines(made(spark, rows)).collect()), key=str)
    assert got == sorted(rows, key=str)


def test_weak_templates_need_many_occurrences(spark):
    rows = [(i, f"page {i} of it\nown{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(lt.MASKED)]
    assert lt.dedup_lines(made(spark, rows)).where("n_dropped > 0").count() == lt.MASKED - 1
    assert lt.dedup_lines(made(spark, rows[:-1])).where("n_dropped > 0").count() == 0


def test_lines_that_recur_as_they_stand(spark):
    rows = [(i, f"Les.\nAnd ornd.\npage 3\n7 of 9 seen here\nErreth was the that\nown{chr(97 + i)} alone\npart {i} of it all") for i in range(2)]
    got = {r.doc_id: r.text for r in lt.dedup_lines(made(spark, rows)).collect()}
    assert got == {0: rows[0][1], 1: "ownb alone\npart 1 of it all"}


def test_passages_inside_lines(spark, random_prose):
    rng = random.Random(5)
    passage = random_prose(rng, 60).split()
    rows = []
    for i in range(12):  # whole, cut, wrapped elsewhere, with blanks of other kinds, and too short
        part = passage[i % 3 : 60 - i % 4] if i % 5 else passage[:49]
        blank = rng.choice([" ", "  ", "\n", " \t"])
        rows.append((i, random_prose(rng, rng.randint(0, 30)) + " " + blank.join(part) + rng.choice([" ", "\n", " \r\n"]) + random_prose(rng, rng.randint(0, 30))))
    rows += [(20, " ".join(passage)), (21, " ".join(passage) + " " + " ".join(passage)), (None, " ".join(passage)), (22, None), (20, "x " + " ".join(passage)), (2, rows[2][1])]
    got = lt.dedup_lines(made(spark, rows).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == brute(rows)
    assert sum(r.n_passages for r in got) > 8 and all(r.dropped_chars == len(t or "") - len(r.text or "") for r in got for i, t in rows if (i, r.doc_id) == (21, 21))


def test_a_text_and_a_line_of_many_megabytes(spark, random_prose):
    rng = random.Random(6)
    line, passage = random_prose(rng, 3000), random_prose(rng, 80)
    text = " ".join(f"{line} {i}" for i in range(3_000_000 // len(line))) + " " + passage
    got = {r.doc_id: r.text for r in lt.dedup_lines(made(spark, [(1, "start " + passage), (2, text), (3, text)])).collect()}
    assert got[1] == "start " + passage and got[3] == "" and got[2] == text[: -len(passage)]


def test_empty_table_and_clashing_names(empty, clashing, docs):
    assert lt.dedup_lines(empty).count() == 0
    out = lt.dedup_lines(clashing)
    assert out.columns == [c for c in clashing.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped", "n_passages", "dropped_chars"]
    assert out.count() == docs.count()


def test_packed_texts_come_back():
    for text in ("", "a", "é\ud800 x\n" * 3, "word " * 500_000):
        assert lt.unpacked(lt.packed(text)).decode("utf-8", "surrogatepass") == text


def test_no_key_travels_as_a_row(spark, monkeypatch, random_prose):
    """Tables have one row for each group of rows, whatever lines and windows there are."""
    rng = random.Random(9)
    passage = random_prose(rng, 70)
    rows = [(i, f"{LINE}\n{random_prose(rng, 5)}\n{random_prose(rng, 4)} {passage}\n{LINE}") for i in range(40)]
    tables = []

    def counted(df, name, *more, write=lt.written):
        table = write(df, name, *more)
        tables.append((name, table.count()))
        return table

    monkeypatch.setattr(lt, "written", counted)
    got = sorted(((r.doc_id, r.text) for r in lt.dedup_lines(made(spark, rows).coalesce(2)).collect()), key=str)
    assert got == brute(rows)
    assert tables and max(n for _, n in tables) <= 2, tables


def test_groups_of_one_task_meet(spark):
    half = 150_000  # a row counts for 64 bytes at least
    docs = spark.range(0, 2 * half, 1, 1).selectExpr("id AS doc_id", f"concat('ab ', id % {half}) AS text")
    got = lt.dedup_lines(docs).selectExpr(f"doc_id >= {half} AS later", "text", "n_dropped")
    assert got.where("later = (text = '') AND n_dropped = int(later)").count() == got.count() == 2 * half


def test_lines_of_texts_found_at_once_are_those_found_one_by_one(random_prose):
    rng = random.Random(10)
    texts = [b"", b"\n", b"a", b"7\n\n x9 \r\n", b" \n b 1\tc\n", random_prose(rng, 50).replace(" e", "\n1").encode(), "\u00e9 \u00a0 \ufffd5\n".encode(), b""]
    for some in (texts, texts[:1], texts[::-1]):
        for a, b in zip(lt._lines(some), lt._tokens([x for t in some for x in t.split(b"\n")]), strict=True):
            assert np.array_equal(a, b)


def test_anchors_are_dealt_evenly(random_prose):
    _, starts, anchor, _ = lt._runs([random_prose(random.Random(11), 60_000).encode()])
    n = np.bincount((anchor[starts] >> np.uint64(60)).astype(np.int64), minlength=16)
    assert n.sum() > 1000 and n.max() < 2 * n.min()
