import hashlib
import io
import json
import struct

import numpy as np
import pytest
from builders import icc, image, jpeg, tiff
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterlake.archive import codecs, jobs
from rasterlake.archive import format as fmt
from rasterlake.functions import colour, gf256, images
from rasterlake.operators import facets
from rasterlake.sources import build
from rasterlake.sources import icc as profiles
from rasterlake.sources import images as sources
from rasterlake.sources import tiff as reader
from rasterlake.streaming import ingest


def entries(raw):
    mark, found = reader.directories(reader.window(io.BytesIO(raw)))
    return mark, found


@pytest.mark.parametrize(("w", "h", "samples", "photometric", "bits"), [(1024, 1024, 1, 32803, 16), (512, 700, 3, 2, 16), (1025, 1024, 1, 32803, 16), (700, 600, 3, 2, 8)])
def test_layout_finds_pixels_without_gaps(w, h, samples, photometric, bits):
    raw, pixels = image(w, h, samples, photometric, bits, orientation=6)
    size, turn, found = reader.layout(io.BytesIO(raw))
    assert (size, turn) == (len(raw), 6)
    assert [s.offset for s in found] == [0, *np.cumsum([s.len for s in found])[:-1]] and sum(s.len for s in found) == size
    (own,) = [s for s in found if s.spec]
    assert raw[own.offset : own.offset + own.len] == pixels and own.spec.layout == ("cfa" if samples == 1 else "chunky")


def test_small_compressed_and_cut_images_stay_bytes():
    assert all(s.spec is None for s in reader.layout(io.BytesIO(image(64, 64, 3, 2)[0]))[2])
    raw = image(1024, 1024, 1, 32803)[0]
    assert all(s.spec is None for s in reader.layout(io.BytesIO(raw[: len(raw) // 2]))[2])
    with pytest.raises(ValueError, match="not a TIFF"):
        reader.layout(io.BytesIO(bytes(100)))


def test_values_of_every_type_in_both_orders():
    for mark in "<>":
        raw = tiff([(271, 2, 4, b"HB\0\0"), (33434, 5, 1, struct.pack(mark + "II", 10, 1250)), (37380, 10, 1, struct.pack(mark + "ii", -1, 3)), (5000, 12, 2, struct.pack(mark + "dd", 0.5, -2)), (5001, 9, 2, struct.pack(mark + "ii", -5, 7)), (5002, 7, 4, b"0231"), (37500, 7, 4096, bytes(4096)), (5003, 77, 1, 0), (5004, 4, 1 << 21, 0), (5005, 5, 9, 99_999_999)], mark=mark)
        own, (d,) = entries(raw)
        v = {e.tag: reader.value(own, e) for e in d.entries}
        assert v[271] == {"tag": "text", "text": "HB"} and v[5002] == {"tag": "text", "text": "0231"}
        assert v[33434] == {"tag": "rats", "rats": [{"n": 10, "d": 1250}]} and v[37380]["rats"] == [{"n": -1, "d": 3}]
        assert v[5000] == {"tag": "reals", "reals": [0.5, -2.0]} and v[5001] == {"tag": "ints", "ints": [-5, 7]}
        assert v[37500] == {"tag": "binary", "bin_len": 4096}
        assert [v[t]["tag"] for t in (5003, 5004, 5005)] == ["unreadable"] * 3 and "unknown type 77" in v[5003]["why"]


def test_directories_are_read_once_and_jpegs_have_them_too():
    loop = tiff([(330, 4, 1, 8), (256, 4, 1, 5)], after=8)
    assert len(entries(loop)[1]) == 1
    assert entries(jpeg(loop))[1][0].first(256).value_offset == 5
    with pytest.raises(ValueError, match="without Exif"):
        entries(b"\xff\xd8\xff\xda\0\x02rest")


@given(st.binary(max_size=200))
@settings(max_examples=150, deadline=None)
def test_hostile_bytes_fail_with_a_reason(raw):
    for data in (raw, b"II*\0" + raw, b"\xff\xd8" + raw):
        try:
            entries(data)
        except ValueError:
            pass


def test_profiles():
    text = "Näme".encode("utf-16-be")
    name = b"mluc" + bytes(4) + struct.pack(">II", 1, 12) + b"enUS" + struct.pack(">II", len(text), 28) + text
    found = profiles.parse(icc([(b"desc", name), (b"cicp", b"cicp" + bytes(4) + bytes([9, 16, 0, 1]))]))
    assert (found["description"], found["curve"], found["bt2020"]) == ("Näme", "pq", True)
    assert (found["version"], found["primaries"], found["transfer"], found["hdr"]) == ("4.3", "BT.2020 / BT.2100", "PQ (SMPTE ST 2084)", True)
    for bad in (b"", icc([], b"nope"), icc([], count=2**32 - 1)):
        with pytest.raises(ValueError):
            profiles.parse(bad)


@given(st.integers(1, 12), st.integers(1, 6), st.integers(0, 2**32))
@settings(max_examples=40, deadline=None)
def test_any_k_shards_give_the_rest(k, m, seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(0, 256, (k, 24), np.uint8)
    every = np.concatenate([data, gf256.parity(data, m)])
    good = np.ones(k + m, bool)
    good[rng.permutation(k + m)[:m]] = False
    broken = np.where(good[:, None], every, np.uint8(7))
    assert (gf256.repaired(broken, good, k) == every).all()
    good[np.flatnonzero(good)[0]] = False
    with pytest.raises(ValueError, match="are left"):
        gf256.repaired(broken, good, k)


@pytest.mark.parametrize("codec", sorted(codecs.REGISTRY))
@pytest.mark.parametrize(("w", "h", "samples", "bits", "layout"), [(64, 48, 1, 16, "cfa"), (33, 17, 3, 16, "chunky"), (40, 24, 3, 8, "chunky"), (7, 3, 1, 8, "cfa"), (1, 1, 3, 8, "chunky")])
def test_pixels_come_back(codec, w, h, samples, bits, layout):
    for le in (True, False):
        spec = reader.Spec(w, h, bits, samples, layout, le)
        data = np.random.default_rng(w).integers(0, 256, spec.size, np.uint8).tobytes()
        own = codecs.codec_of(codec)
        assert codecs.decode_pixels(codecs.encode_pixels(data, spec, own), spec, own) == data


def test_archives_give_files_back_and_find_damage():
    raw, pixels = image(1024, 1024, 1, 32803)
    made = fmt.pack(raw, "a.tif", "zlib", fmt.Parity(8, 2, 4096), preview=b"preview")
    assert fmt.unpack(made) == raw and fmt.is_archive(made) and not fmt.is_archive(raw) and len(made) < 0.8 * len(raw)
    m = fmt.verify(made, quick=True)
    assert m["original"]["sha256"] == hashlib.sha256(raw).hexdigest() and m["container"] == "tiff"
    bare = fmt.skeleton(made)
    assert len(bare) == len(raw) and bare[-17:] == b"trailing-metadata" and entries(bare)[1][0].first(256) is not None
    broken = bytearray(made)
    for at in (100, 5000, len(made) - 2):
        broken[at] ^= 1
    broken = bytes(broken)
    with pytest.raises(fmt.ArchiveError):
        fmt.verify(broken)
    assert [x[3] for x in fmt.scan(broken)] == [True] and fmt.repair(broken) == made
    worse = bytearray(broken)
    worse[9000] ^= 1
    with pytest.raises(fmt.ArchiveError, match="unrepairable"):
        fmt.repair(bytes(worse))
    # the first manifest is lost: the next is used
    f = fmt.footer(made)
    at = f.preview + len(fmt.MAGIC) + f.body
    assert fmt.manifest(made[:at] + bytes(50) + made[at + 50 :]) == fmt.manifest(made)


@given(st.binary(max_size=3000), st.sampled_from(sorted(codecs.REGISTRY)), st.booleans())
@settings(max_examples=40, deadline=None)
def test_any_bytes_come_back(data, codec, parity):
    assert fmt.unpack(fmt.pack(data, "x", codec, fmt.Parity(3, 1, 64) if parity else None)) == data


def test_previews():
    board = np.kron(np.indices((8, 8)).sum(0) % 2, np.ones((1, 1))).astype(np.uint8)[..., None].repeat(3, 2) * 255
    assert 180 <= colour.encoded(images.downscaled(board, 1, 1))[0, 0, 0] <= 195
    red_green = np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8)
    assert images.upright(red_green, 8).tolist() == [[[0, 255, 0]], [[255, 0, 0]]]
    assert (images.fit(1440, 1080, 512), images.fit(100, 80, 512)) == ((512, 384), (100, 80))
    assert images.preview(board, 6, 4)[:8] == b"\x89PNG\r\n\x1a\n"
    assert colour.curve("pq", np.array([0.0, 1.0])) == pytest.approx([0, 10_000 / 203], rel=0.01) and colour.curve("hlg", np.array(0.75)) == pytest.approx(1, abs=0.02)
    a = np.arange(48).reshape(6, 8)
    assert (images.merge_mosaic(images.split_mosaic(a)) == a).all()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_bytes(image(1024, 1024, 1, 32803, orientation=6)[0])
    gps = lambda *x: struct.pack("<IIIIII", *x)
    inner = tiff([(271, 2, 6, b"Canon\0"), (272, 2, 10, b"Canon EOS\0"), (315, 2, 5, b"Anna\0"), (306, 2, 20, b"2018:04:09 19:23:29\0"), (256, 4, 1, 6000), (257, 4, 1, 4000), (33434, 5, 1, struct.pack("<II", 10, 1250)), (33437, 5, 1, struct.pack("<II", 28, 10)), (37386, 5, 1, struct.pack("<II", 45, 1)), (34855, 3, 1, 400), (262, 3, 1, 4242), (50721, 10, 9, struct.pack("<18i", *[1, 3] * 9)), (64321, 3, 1, 5), (50728, 5, 1, struct.pack("<II", 447106, 1000000)), (34853, 4, 1, 1000)])
    raw = inner.ljust(1000, b"\0") + struct.pack("<H", 4)
    raw += struct.pack("<HHI4s", 1, 2, 2, b"S\0\0\0") + struct.pack("<HHII", 2, 5, 3, 1100) + struct.pack("<HHI4s", 3, 2, 2, b"E\0\0\0") + struct.pack("<HHII", 4, 5, 3, 1124) + struct.pack("<I", 0)
    raw = raw.ljust(1100, b"\0") + gps(51, 1, 30, 1, 0, 1) + gps(0, 1, 7, 1, 30, 1)
    (tmp_path / "in" / "b.jpg").write_bytes(jpeg(raw))
    (tmp_path / "in" / "c.txt").write_bytes(b"no image")
    return tmp_path


def paths(spark, folder, end="*"):
    return spark.createDataFrame([(str(p),) for p in sorted((folder / "in").glob(end))], "path string")


def test_entries_fields_and_summary(spark, folder):
    e = sources.image_entries(paths(spark, folder))
    assert {r.status for r in e.where("path like '%c.txt'").collect()} == {"FAILED"}
    f = {r["name"]: r for r in facets.fields(e).where("path like '%.jpg'").collect()}
    shown = {k: f[k].display for k in ("ExposureTime", "FNumber", "FocalLength", "ISOSpeedRatings", "DateTime", "PhotometricInterpretation", "AsShotNeutral", "Artist", "GPSLatitudeRef")}
    assert shown == {"ExposureTime": "1/125 s", "FNumber": "f/2.8", "FocalLength": "45 mm", "ISOSpeedRatings": "ISO 400", "DateTime": "2018-04-09T19:23:29", "PhotometricInterpretation": "4242", "AsShotNeutral": "0.447106", "Artist": "Anna", "GPSLatitudeRef": "S"}
    assert f["ColorMatrix1"].display == ", ".join(["1/3"] * 8) + " ⋯ (9 values)" and f["ColorMatrix1"].matrix == ["  ".join([" 0.333333"] * 3)] * 3
    assert (f["ISOSpeedRatings"].type_note, f["ColorMatrix1"].type_note) == ("SHORT[1]", "SRATIONAL[9]")
    hidden = {r["name"]: r for r in facets.fields(e, redact=True).collect()}
    assert hidden["Artist"].display == "<redacted>" and hidden["Artist"].value is None and len(hidden) == len({r["name"] for r in facets.fields(e).collect()})
    assert facets.fields(e, everything=True).where("tag = 64321").count() == 1
    s = {r.path[-5:]: r for r in facets.summary(facets.fields(e)).collect()}
    assert (s["b.jpg"].camera, s["b.jpg"].taken, s["b.jpg"].aspect, s["b.jpg"].megapixels) == ("Canon EOS", "Monday 9 April 2018, 19:23", "3:2", "24.0 MP")
    assert (s["b.jpg"].lat, s["b.jpg"].lon) == (-51.5, 7 / 60 + 30 / 3600)
    assert s["a.tif"].Orientation == "rotated 90° CW (6)"


def test_data_source_and_segments(spark, folder):
    sources.register(spark)
    names = ",".join(r.path for r in paths(spark, folder).collect())
    read = spark.read.format("image_entries").option("paths", names).load()
    assert read.count() == sources.image_entries(paths(spark, folder)).count()
    seg = sources.image_segments(paths(spark, folder)).collect()
    assert [s.kind for s in seg if s.path.endswith(".tif")] == ["verbatim", "image", "verbatim"] and sum(s.status == "FAILED" for s in seg) == 2
    kinds = {r.container for r in sources.identified(spark.read.format("binaryFile").load(str(folder / "in"))).collect()}
    assert kinds == {"tiff", "jpeg", "unknown"}


def test_jobs_over_files(spark, folder):
    out = jobs.archive(paths(spark, folder), str(folder / "out"), parity=fmt.Parity(8, 2, 4096)).collect()
    assert {r.status for r in out} == {"ok"} and (folder / "out" / "a.rla.tif").exists()
    made = spark.createDataFrame([(r.target,) for r in out], "path string")
    assert {r.status for r in jobs.verify(made).collect()} == {"ok (full)"} and {r.status for r in jobs.verify(made, quick=True).collect()} == {"ok (quick)"}
    assert sources.image_entries(made.where("path like '%a.rla.tif'")).where("tag = 256").count() == 1
    assert {r.status for r in jobs.restore(made, str(folder / "back")).collect()} == {"ok"}
    for p in (folder / "in").iterdir():
        assert (folder / "back" / p.name).read_bytes() == p.read_bytes()
    assert {r.error_code for r in jobs.restore(made, str(folder / "back")).collect()} == {"exists"}
    raw = bytearray((folder / "out" / "a.rla.tif").read_bytes())
    raw[1000] ^= 255
    (folder / "out" / "a.rla.tif").write_bytes(raw)
    assert sorted(r.status for r in jobs.verify(made).collect()) == ["FAILED", "ok (full)", "ok (full)"]
    assert sorted(r.status for r in jobs.repair(made).collect()) == ["clean", "clean", "repairable"]
    assert sorted(r.status for r in jobs.repair(made, apply=True).collect()) == ["clean", "clean", "repaired"]
    assert {r.status for r in jobs.verify(made).collect()} == {"ok (full)"}
    assert {r.error_code for r in jobs.verify(paths(spark, folder, "*.txt")).collect()} == {"footer"}
    assert jobs.archive_name("x/a.3FR") == "x/a.rla.3FR"


def test_previews_manifests_and_measures(spark, folder):
    (folder / "in" / "rgb.tif").write_bytes(image(900, 600, 3, 2, 8, orientation=6)[0])
    made = {r.path.rpartition("/")[2]: r for r in jobs.previews(paths(spark, folder), 128).collect()}
    assert (made["rgb.tif"].width, made["rgb.tif"].height, made["rgb.tif"].png[:4]) == (85, 128, b"\x89PNG")
    assert made["a.tif"].status == "FAILED" and made["a.tif"].error_code == "preview"
    done = jobs.archive(paths(spark, folder, "rgb.tif"), str(folder / "out")).select(F.col("target").alias("path"))
    (m,) = jobs.manifests(done).collect()
    assert (m.manifest.original.name, m.manifest.version, [s.spec is not None for s in m.manifest.segments]) == ("rgb.tif", 1, [False, True, False])
    (back,) = jobs.previews(done, 128).collect()
    assert (back.width, back.height) == (85, 128)


def test_profile_column(spark):
    raw = icc([(b"cicp", b"cicp" + bytes(4) + bytes([12, 18, 0, 1]))])
    out = spark.createDataFrame([(1, raw), (2, b"x"), (3, None)], "i int, raw binary").select("i", profiles.profile(F.col("raw")).alias("p")).orderBy("i").collect()
    assert [(r.p.primaries, r.p.hdr) for r in out] == [("Display P3", True), (None, None), (None, None)]


def test_stream_reads_each_file_once(spark, folder):
    target, check = str(folder / "table"), str(folder / "check")
    for more in (None, "d.txt"):
        if more:
            (folder / "in" / more).write_bytes(b"new")
        ingest.catalogue(ingest.new_files(spark, str(folder / "in")), target, check).awaitTermination()
    known = spark.read.parquet(target)
    assert known.count() == 4
    (folder / "in" / "d.txt").write_bytes(b"rot")
    now = spark.read.format("binaryFile").load(str(folder / "in")).select("path", F.sha2("content", 256).alias("digest"))
    assert [r.path[-5:] for r in ingest.changed(now, known).collect()] == ["d.txt"]


def test_archives_begin_with_a_preview_and_tell_of_themselves(spark, folder):
    (folder / "in" / "rgb.tif").write_bytes(image(900, 600, 3, 2, 8, orientation=6)[0])
    out = jobs.archive(paths(spark, folder), str(folder / "out"), edge=64).collect()
    kept = spark.createDataFrame([(r.target,) for r in out], "path string")
    first = {r.path.rpartition("/")[2]: r.preview for r in jobs.stored_previews(kept).collect()}
    assert first["rgb.rla.tif"][:4] == b"\x89PNG" and first["a.rla.tif"] is None and first["c.rla.txt"] is None
    assert (folder / "out" / "rgb.rla.tif").read_bytes().startswith(first["rgb.rla.tif"])
    m = {r.manifest.original.name: r.manifest for r in jobs.manifests(kept).collect()}
    assert m["a.tif"].provenance.codec == "zlib" and len(m["a.tif"].provenance.made) == 20
    by = {r.path.rpartition("/")[2]: r for r in out}
    assert by["a.tif"].payload_len == 2 << 20 and by["a.tif"].sha256 == hashlib.sha256((folder / "in" / "a.tif").read_bytes()).hexdigest() and by["a.tif"].peak_rss > 0
    assert {r.status for r in jobs.repair(kept).collect()} == {"no parity"}
    assert not sources.is_archive_file(io.BytesIO(fmt.FOOT * 40)) and sources.is_archive_file(io.BytesIO((folder / "out" / "a.rla.tif").read_bytes()))


def test_chunked_copies_count_and_hash():
    data = bytes(range(256)) * 41
    out = io.BytesIO()
    assert jobs.copied(io.BytesIO(data), out, 100) == (len(data), hashlib.sha256(data).hexdigest()) and out.getvalue() == data


def test_skeletons_are_read_piece_by_piece():
    raw = image(1024, 1024, 1, 32803)[0]
    made = fmt.pack(raw, "a.tif", "zlib", preview=b"some preview")
    f, whole = fmt.Skeleton(io.BytesIO(made)), fmt.skeleton(made)
    rng = np.random.default_rng(2)
    assert f.seek(0, io.SEEK_END) == len(raw)
    for at, n in [(0, 8), (100, 0), (len(raw) - 5, 50), *((int(a), int(b)) for a, b in zip(rng.integers(0, len(raw), 40), rng.integers(0, 3000, 40), strict=True))]:
        f.seek(at)
        assert f.read(n) == whole[at : at + n]
    assert fmt.unpack(made) == raw and fmt.Skeleton(io.BytesIO(fmt.pack(b"", "x", "identity"))).read() == b""


def test_patches_are_what_was_damaged():
    raw = fmt.pack(bytes(range(256)) * 300, "x", "identity", fmt.Parity(4, 2, 1024))
    f = fmt.footer(raw)
    for places in ([50], [50, 5000, 70_000], [f.protected + 20], [f.protected + f.parity - 5], [len(raw) - 3], [f.protected + 20, 90, len(raw) - 3]):
        broken = bytearray(raw)
        for at in places:
            broken[at] ^= 255
        assert fmt.repair(bytes(broken)) == raw
        assert sum(len(x) for _, x in fmt.patches(bytes(broken))) < 4096 + len(places) * 1024
    assert fmt.patches(raw) == []


def test_profiles_without_code_points_are_told_by_name():
    for name, hdr in (("Rec. 2100 PQ", True), ("My HLG screen", True), ("sRGB", False), ("Sunset pq", True)):
        assert profiles.parse(build.colour_profile(description=name))["hdr"] is hdr


def test_built_files_are_read_again():
    for mark in "<>":
        t = build.Tiff(mark)
        raw = t.done(t.directory([(271, 2, "Maker"), (33434, 5, (1, 8)), (256, 4, 7), (330, 4, t.directory([(270, 2, "below")]))]))
        own, found = entries(raw)
        assert own == mark and [d.label for d in found] == ["IFD0", "SubIFD0"] and reader.value(own, found[1].first(270))["text"] == "below"


def test_command_line(spark, folder, capsys):
    from rasterlake.__main__ import main

    (folder / "in" / "rgb.tif").write_bytes(image(900, 600, 3, 2, 8, orientation=6)[0])
    rgb, photo = str(folder / "in" / "rgb.tif"), str(folder / "in" / "b.jpg")
    assert main(["exif", photo], spark) == 0 and "Canon EOS" in capsys.readouterr().out
    assert main(["exif", "--json", "--redact", photo], spark) == 0
    read = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    found = {t["name"]: t for d in read["directories"] for t in d["tags"]}
    assert found["ExposureTime"]["raw"] == [[10, 1250]] and found["Artist"]["redacted"] and "raw" not in found["Artist"]
    assert main(["archive", "--dry-run", rgb], spark) == 0 and "1620000" in capsys.readouterr().out
    assert main(["archive", "--out", str(folder / "o"), "--parity", "6", "--stats", rgb], spark) == 0 and "/s" in capsys.readouterr().out
    assert main(["verify", str(folder / "o" / "rgb.rla.tif")], spark) == 0
    assert main(["thumb", "--out", str(folder / "t"), rgb], spark) == 0 and (folder / "t" / "rgb.tif.png").read_bytes()[:4] == b"\x89PNG"
    assert main(["verify", rgb], spark) == 1


def test_paths_with_commas(spark, folder):
    (folder / "in" / "a,b.tif").write_bytes((folder / "in" / "a.tif").read_bytes())
    sources.register(spark)
    names = json.dumps([str(folder / "in" / "a,b.tif")])
    assert spark.read.format("image_entries").option("paths", names).load().where("status = 'ok'").count() > 5


def test_nearest_place_in_a_hot_spot_and_at_the_edges(spark):
    from rasterlake.operators import lookups

    places = spark.createDataFrame([("pole", "A", 89.9, 10.0, 5), ("date line", "B", 10.0, 179.9, 5), ("town", "C", 48.85, 2.29, 100), ("city", "C", 48.86, 2.35, 2_000_000)], "city string, country string, lat double, lon double, population long")
    points = [(1, 89.8, -170.0), (2, 10.1, -179.8), (3, 48.85, 2.295), (4, -40.0, -140.0), (5, 95.0, 0.0), (6, float("nan"), 0.0), (7, 0.0, float("inf"))] + [(100 + i, 48.85, 2.29) for i in range(2000)]
    got = {r.k: r.city for r in lookups.nearest_place(spark.createDataFrame(points, "k int, lat double, lon double"), places, "k", 200.0).collect()}
    assert (got.pop(1), got.pop(2), got.pop(3)) == ("pole", "date line", "city") and set(got) == set(range(100, 2100)) and set(got.values()) == {"city"}


def test_nearest_place_meets_few_places_and_finds_what_all_pairs_give(spark):
    from rasterlake.operators import lookups

    rng = np.random.default_rng(5)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 6000))).round(3), rng.uniform(-180, 180, 6000).round(3)
    lat[:300], lon[:300] = 40 + rng.uniform(-0.1, 0.1, 300).round(2), 20 + rng.uniform(-0.1, 0.1, 300).round(2)
    lat[300:340] = rng.choice([89.99, -89.99], 40)
    people = [None if i % 97 == 0 else int(x) for i, x in enumerate(rng.integers(0, 1000, 6000))]
    places = [(f"c{i % 700}", str(i % 5), float(lat[i]), float(lon[i]), people[i]) for i in range(4000)] + [("far", None, -80.0, 0.0, 1)]
    points = [(int(i) - (i == 4001), float(lat[i]), float(lon[i])) for i in [*range(200), *range(300, 330), *range(4000, 6000), 4100]]
    df = lookups.nearest_place(spark.createDataFrame(points, "k int, lat double, lon double"), spark.createDataFrame(places, "city string, country string, lat double, lon double, population long"), "k", 900.0)
    got = {r.k: (r.city, r.country, round(r.km, 6)) for r in df.collect()}
    assert len(got) == df.count()

    la, lo = np.radians([p[2] for p in places]), np.radians([p[3] for p in places])
    key, found = lambda x: (x is not None, x or ""), {}
    for k, a, b in points:
        h = np.sin((la - np.radians(a)) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(la) * np.sin((lo - np.radians(b)) / 2) ** 2
        km = 2 * 6371.0088 * np.arcsin(np.sqrt(h))
        found.setdefault(k, []).extend((round(km[i], 6), *places[i][:2], places[i][4]) for i in np.flatnonzero(km <= 900))
    for k, near in found.items():
        if not near:
            assert k not in got
            continue
        first = min(near, key=lambda x: (x[0], key(x[1]), key(x[2]), x[3] is not None, x[3] or 0))
        notable = [x for x in near if None not in (x[3], first[3]) and x[0] <= first[0] + 8 and x[3] >= 4 * first[3]]
        best = max(notable, key=lambda x: (x[3], -x[0], key(x[1]), key(x[2])), default=None) or max(near, key=lambda x: (-x[0], key(x[1]), key(x[2])))
        assert got[k] == (best[1], best[2], best[0]), k

    def joined(plan):
        """Rows that all joins of an executed plan made."""
        name, rows = plan.nodeName(), 0
        if "Join" in name:
            rows = plan.metrics().apply("numOutputRows").value()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
        return rows + sum(map(joined, inner))

    assert joined(df._jdf.queryExecution().executedPlan()) < 80 * len(points)


def test_large_images_and_odd_arrays(spark):
    from rasterlake.operators import pixels

    w, h = 600, 400
    px = np.arange(w * h)
    df = spark.createDataFrame([(px.tolist(), w, h), ([1, 2, 3], 2, 2), (None, 2, 2)], "px array<long>, w int, h int")
    c = F.col
    out = df.select(pixels.cfa_merge(pixels.cfa_split(c("px"), c("w"), c("h")), c("w"), c("h")).alias("same"), pixels.area_average(c("px"), c("w"), c("h"), 3, 2).alias("mean"), pixels.oriented(c("px"), c("w"), c("h"), 3).alias("turned")).collect()
    assert out[0].same == px.tolist() and len(out[0].mean) == 6 and out[0].turned == px[::-1].tolist()
    assert out[1].same is None and out[1].mean is None and out[2].turned is None
