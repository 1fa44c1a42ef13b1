import gzip
import hashlib

import pytest

from rasterlake.llm import warc


def pages(spark, n=60):
    rows = [(i, f"http://x.example/{i}", f"<html>{i % 7} " + "page " * (i % 7 * 10) + "</html>") for i in range(n)]
    rows += [(100, None, None), (101, "u", ""), (None, "v", "<p>" + "null id " * 30), (102, "w\r\nX: y", "é" * 200), (3, "again", rows[3][2]), (3, "again", rows[3][2]), (104, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 30)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_round_trip_and_revisits(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_warc(df, str(tmp_path / "a"))
    got = warc.read_warc(spark, str(tmp_path / "a")).collect()
    assert len(got) == len(rows)
    payload = lambda r: (r[2] or "").encode()
    want = sorted((str(r[0]), len(payload(r)), hashlib.sha256(payload(r)).hexdigest()) for r in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in got) == want
    first, seen = {}, set()
    for r in rows:
        if r[0] is not None and len(payload(r)) >= 100:
            first[payload(r)] = min(first.get(payload(r), r[0]), r[0])
    by_digest = {hashlib.sha256(k).hexdigest(): v for k, v in first.items()}
    for r in sorted(got, key=lambda r: r.record_type):
        to = by_digest.get(r.payload_digest)
        if r.record_type == "response":
            assert hashlib.sha256(r.html).hexdigest() == r.payload_digest and r.refers_to is None
            assert to is None or (r.page_id == to and r.payload_digest not in seen)
            seen.update([r.payload_digest] if to is not None else [])
        else:
            assert r.refers_to == to and r.html is None and r.payload_bytes >= 100
    assert seen == set(by_digest)


def test_files_are_the_same_on_every_run(spark, tmp_path):
    _, df = pages(spark)
    made = []
    for k, part in enumerate((df, df.repartition(9))):
        warc.write_warc(part, str(tmp_path / str(k)), roll_bytes=800)
        made.append({p.name: p.read_bytes() for p in (tmp_path / str(k)).iterdir() if p.suffix in (".gz", ".json")})
    assert made[0] == made[1] and len(made[0]) > 5
    assert not (tmp_path / "0" / "_temporary-files").exists()


def test_records_sort_and_files_roll(spark, tmp_path):
    _, df = pages(spark)
    files = warc.write_warc(df, str(tmp_path / "a"), roll_bytes=500)["files"]
    ids = []
    for f in files:
        raw = (tmp_path / "a" / f["file"]).read_bytes()
        assert len(raw) == f["bytes"] and hashlib.sha256(raw).hexdigest() == f["sha256"]
        heads = [h for h, _ in warc.records(gzip.open(tmp_path / "a" / f["file"]))]
        assert heads[0]["warc-type"] == "warcinfo" and heads[0]["warc-filename"] == f["file"]
        heads = heads[1:]
        assert len(heads) == f["records"]
        ids += [int(h.get("x-page-id", -1)) for h in heads]
    assert ids == sorted(ids)


def test_revisits_name_their_response(spark, tmp_path):
    rows, df = pages(spark)
    by_id, revisits = {}, []
    for f in warc.write_warc(df, str(tmp_path / "a"))["files"]:
        for h, _ in warc.records(gzip.open(tmp_path / "a" / f["file"])):
            by_id[h["warc-record-id"]] = h
            revisits += [h] * (h["warc-type"] == "revisit")
    assert len(by_id) >= len(set(rows)) and len(revisits) > 30
    for h in revisits:
        to = by_id[h["warc-refers-to"]]
        assert to["warc-type"] == "response" and to["warc-payload-digest"] == h["warc-payload-digest"]
        assert to["x-page-id"] == h["x-refers-to-page-id"] and to.get("warc-target-uri") == h.get("warc-refers-to-target-uri")


def test_a_payload_of_many_megabytes(spark, tmp_path):
    html = "<p>" + "long page " * 2_000_000
    warc.write_warc(spark.createDataFrame([(1, "u", html), (2, "v", html)], "page_id long, url string, html string"), str(tmp_path / "a"))
    got = {r.page_id: r for r in warc.read_warc(spark, str(tmp_path / "a"), payloads=False).collect()}
    assert {(r.payload_bytes, r.payload_digest) for r in got.values()} == {(len(html), hashlib.sha256(html.encode()).hexdigest())}
    assert (got[1].record_type, got[2].record_type, got[2].refers_to) == ("response", "revisit", 1)


def test_damage_is_found(spark, tmp_path):
    _, df = pages(spark)
    name = warc.write_warc(df, str(tmp_path / "a"))["files"][0]["file"]
    at = tmp_path / "a" / name
    raw = gzip.decompress(at.read_bytes()).replace(b"page page", b"pagX page", 1).replace(b"<html>", b"<htmL>", 1)
    at.write_bytes(gzip.compress(raw))
    (tmp_path / "a" / f".{name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="damaged record"):
        warc.read_warc(spark, str(tmp_path / "a")).collect()


def test_empty_table_and_extra_columns(spark, tmp_path):
    from pyspark.sql import functions as F

    _, df = pages(spark)
    warc.write_warc(df.limit(0), str(tmp_path / "a"))
    assert warc.read_warc(spark, str(tmp_path / "a")).count() == 0
    warc.write_warc(df.select("*", *(F.lit("x").alias(c) for c in ("piece", "note", "digest", "first", "n"))), str(tmp_path / "b"))
    assert warc.read_warc(spark, str(tmp_path / "b")).count() == df.count()
