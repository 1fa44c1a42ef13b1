"""The engine's queries over the driver's tables, each with the same query in SQL.

The tables hold no images. Documents stand in for files (their lines of 200 bytes or more for image
regions), events for metadata entries, customers and suppliers for photographs and cities, and
embeddings for 8 x 8 pixel grids. Coordinates, tags and codes made from keys are stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour, dictionaries, formats
from ..operators import export, facets, integrity, layout, lookups, pixels, stats, tags

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("total_len"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("len", F.octet_length("line").cast("long")).withColumn("size", c("len") + 1)
    return layout.run_offsets(lines, "doc_id", ["pos"], "size").where("len >= 200").select("doc_id", c("start").alias("src_offset"), "len")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.tile(regions(spark, sf_dir), objects(spark, sf_dir), "doc_id").drop("status")


_SEGMENTS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT doc_id, strlen(line) AS len, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS src_offset FROM l),
reg AS (SELECT * FROM o WHERE len >= 200), obj AS (SELECT doc_id, strlen(text) AS total_len FROM documents),
cur AS (SELECT *, coalesce(lag(src_offset + len) OVER (PARTITION BY doc_id ORDER BY src_offset), 0) AS cursor FROM reg),
ends AS (SELECT doc_id, max(src_offset + len) AS e FROM reg GROUP BY doc_id),
parts AS (SELECT doc_id, src_offset, len, 'image' AS kind FROM reg
  UNION ALL SELECT doc_id, cursor, src_offset - cursor, 'verbatim' FROM cur WHERE src_offset > cursor
  UNION ALL SELECT doc_id, coalesce(e, 0), total_len - coalesce(e, 0), 'verbatim' FROM obj LEFT JOIN ends USING (doc_id) WHERE total_len > coalesce(e, 0)),
seg AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY src_offset) - 1 AS seg_no FROM parts)
"""


@query(_SEGMENTS + "SELECT doc_id, seg_no, src_offset, len, kind FROM seg")
def segment_tile(spark, sf_dir):
    return segments(spark, sf_dir)


@query(_SEGMENTS + """, v AS (SELECT *, coalesce(lag(src_offset + len) OVER (PARTITION BY doc_id ORDER BY src_offset), 0) AS before FROM seg)
SELECT doc_id, count(*) AS n_segments, bool_and(src_offset = before) AS contiguous, sum((src_offset < before)::INT) AS overlaps, max(src_offset + len) = any_value(total_len) AS complete FROM v JOIN obj USING (doc_id) GROUP BY doc_id""")
def layout_validate(spark, sf_dir):
    return layout.validate(segments(spark, sf_dir), objects(spark, sf_dir), "doc_id")


@query(_SEGMENTS + "SELECT doc_id, coalesce(sum(len) FILTER (kind = 'image'), 0) AS payload_len, coalesce(sum(len) FILTER (kind = 'verbatim'), 0) AS skeleton_len FROM seg GROUP BY doc_id")
def payload_skeleton(spark, sf_dir):
    return layout.payload(segments(spark, sf_dir), objects(spark, sf_dir), "doc_id")


@query(_SEGMENTS + "SELECT doc_id, min_by(seg_no, (len, seg_no)) AS seg_no, min(len) AS len FROM seg WHERE kind = 'image' GROUP BY doc_id")
def smallest_preview(spark, sf_dir):
    return layout.smallest(segments(spark, sf_dir), "doc_id")


@query(_SEGMENTS + "SELECT doc_id, count(*) AS segments, coalesce(sum(len) FILTER (kind = 'image'), 0) AS payload_len, coalesce(sum(len) FILTER (kind = 'verbatim'), 0) AS skeleton_len, (ceil(coalesce(sum(len) FILTER (kind = 'image'), 0) * 0.5::DOUBLE) + coalesce(sum(len) FILTER (kind = 'verbatim'), 0))::BIGINT AS stored FROM seg GROUP BY doc_id")
def planned_sizes(spark, sf_dir):
    """A dry run: what archives of half the pixels' size would hold."""
    return layout.planned(segments(spark, sf_dir), "doc_id", 0.5)


@query("""WITH r AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT o, CASE WHEN o % 3 = 1 AND n > 1 THEN 'overlap' WHEN o % 3 = 2 THEN 'past the end' ELSE 'ok' END AS status, CASE WHEN (o % 3 = 1 AND n > 1) OR o % 3 = 2 THEN 0 ELSE n + 1 END AS segments FROM r GROUP BY o, n""")
def layout_status(spark, sf_dir):
    """Layouts whose regions overlap or go past the end are told, not tiled."""
    li = table(spark, sf_dir, "lineitem").withColumn("ten", lit(10))
    r = layout.run_offsets(li, "l_orderkey", _ORDER, "ten").select(c("l_orderkey").alias("o"), (c("start") + F.when(c("l_orderkey") % 3 == 1, 0).otherwise(0)).cast("long").alias("src_offset"), F.when((c("l_orderkey") % 3 == 1) & (c("start") == 0), 11).otherwise(10).cast("long").alias("len"))
    objects = r.groupBy("o").agg((F.max(c("src_offset") + c("len")) + F.when(c("o") % 3 == 2, -1).otherwise(5)).alias("total_len"))
    out = layout.tile(r, objects, "o")
    return out.groupBy("o", "status").agg(F.count("seg_no").alias("segments"))


@query("SELECT doc_id, strlen(text) AS total_len, sha256(text) AS digest, substr(sha256(text), 1, 16) AS prefix FROM documents")
def object_digest(spark, sf_dir):
    return integrity.digests(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT doc_id, greatest((strlen(text) + 1023) // 1024, 1) AS shards FROM documents), t AS (SELECT *, (shards + 31) // 32 AS stripes FROM s)
SELECT doc_id, shards, stripes, stripes * 2 * 1024 AS parity_bytes, (26 + (shards + stripes * 2) * 4) * 2 + stripes * 2 * 1024 AS section_len FROM t""")
def parity_plan(spark, sf_dir):
    p = formats.parity_plan(c("total_len"), shard=1024)
    return objects(spark, sf_dir).select("doc_id", *(v.alias(k) for k, v in p.items()))


_SHARDS = """WITH h AS (SELECT doc_id, hex(encode(text)) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(greatest((length(x) + 2047) // 2048, 1))) AS shard_no FROM h),
d AS (SELECT doc_id, shard_no, shard_no // 4 AS stripe_no, sha256(unhex(rpad(substr(x, (shard_no * 2048 + 1)::BIGINT, 2048), 2048, '0'))) AS digest FROM s)
"""


def _shards(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.hex(F.encode("text", "UTF-8")).alias("x"))
    return integrity.shards(docs, "doc_id", "x", 2048, 4, "0").select("doc_id", "shard_no", "stripe_no", F.sha2(F.unhex("bytes"), 256).alias("digest"))


@query(_SHARDS + "SELECT * FROM d")
def shard_digests(spark, sf_dir):
    return _shards(spark, sf_dir)


def _damage(spark, sf_dir) -> DataFrame:
    want = _shards(spark, sf_dir)
    found = want.withColumn("digest", F.when((c("doc_id") * 31 + c("shard_no")) % 5 == 0, lit("damaged")).otherwise(c("digest")))
    return integrity.damage(found, want, "doc_id", "digest")


_DAMAGE = _SHARDS + ", b AS (SELECT doc_id, stripe_no, count(*) AS bad FROM d WHERE (doc_id * 31 + shard_no) % 5 = 0 GROUP BY ALL)\n"


@query(_DAMAGE + "SELECT * FROM b")
def stripe_damage(spark, sf_dir):
    return _damage(spark, sf_dir)


@query(_DAMAGE + "SELECT doc_id, count(*) AS stripes, sum(bad) AS bad, bool_and(bad <= 1) AS repairable FROM b GROUP BY doc_id")
def repairable_objects(spark, sf_dir):
    return integrity.repairable(_damage(spark, sf_dir), "doc_id", 1)


@query("""WITH o AS (SELECT lang, strlen(text) AS original, strlen(text) * 53 // 100 AS stored FROM documents)
SELECT lang, count(*) AS n_objects, sum(original) AS original, sum(stored) AS stored, grouping(lang) AS is_total, CASE WHEN sum(original) = 0 THEN 1.0 ELSE sum(stored)::DOUBLE / sum(original)::DOUBLE END AS ratio
FROM o GROUP BY GROUPING SETS ((lang), ())""")
def storage_totals(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    o = table(spark, sf_dir, "documents").select("lang", n.alias("original"), F.floor(n * 53 / 100).alias("stored"))
    return layout.totals(o, "lang", "original", "stored")


@query("""SELECT doc_id, k, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE)
WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS shown
FROM (SELECT doc_id, k, strlen(text) * pow(37, k)::BIGINT AS n FROM documents, (SELECT unnest(range(7)) AS k))""")
def human_sizes(spark, sf_dir):
    o = objects(spark, sf_dir).withColumn("k", F.explode(F.array(*(lit(i).cast("long") for i in range(7)))))
    return o.select("doc_id", "k", formats.human_bytes(c("total_len") * F.pow(lit(37.0), c("k")).cast("long")).alias("shown"))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_KIND = "CASE event_id % 5 WHEN 0 THEN 'Gps' WHEN 1 THEN 'Interop' WHEN 2 THEN 'Exif' ELSE 'Main' END"
_TAG = "CASE WHEN event_id % 5 <= 1 THEN event_id % 37 WHEN event_id % 5 = 2 THEN 33400 + event_id % 900 ELSE 250 + event_id % 120 END"
_ENTRIES = f"""WITH dim(ns, tag, name, kind) AS (VALUES {_values(dictionaries.tag_rows())}),
e AS (SELECT event_id, {_KIND} AS ifd_kind, {_TAG} AS tag, CASE event_id % 5 WHEN 0 THEN 'gps' WHEN 1 THEN 'interop' ELSE 'tiff' END AS ns,
  CASE event_id % 5 WHEN 0 THEN 'GPS' WHEN 1 THEN 'Interop' WHEN 2 THEN 'Exif' ELSE 'IFD0' END AS label FROM events),
f AS (SELECT e.event_id, e.ifd_kind, e.tag, e.label, dim.name, dim.kind FROM e LEFT JOIN dim ON e.ns = dim.ns AND e.tag = dim.tag)
"""


def _entries(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_KIND).alias("ifd_kind"), F.expr(_TAG).cast("int").alias("tag"))
    label = F.when(c("ifd_kind") == "Gps", "GPS").when(c("ifd_kind") == "Main", "IFD0").otherwise(c("ifd_kind"))
    return tags.with_names(e.withColumn("label", label))


@query(_ENTRIES + "SELECT event_id, ifd_kind, tag, kind, coalesce(name, printf('Tag(0x%04X)', tag)) AS label FROM f")
def tag_lookup(spark, sf_dir):
    return _entries(spark, sf_dir).select("event_id", "ifd_kind", "tag", "kind", formats.tag_label(c("tag"), c("name")).alias("label"))


@query(_ENTRIES + "SELECT label, count(*) AS field_count, count(*) FILTER (name IS NULL) AS unknown_count FROM f GROUP BY label")
def unknown_count(spark, sf_dir):
    return tags.field_counts(_entries(spark, sf_dir))


@query(_ENTRIES + "SELECT event_id, label, name FROM f WHERE name IS NOT NULL AND (lower(name) LIKE '%date%' OR lower(name) LIKE '%lat%')")
def tag_filter(spark, sf_dir):
    return tags.selected(_entries(spark, sf_dir), tags=["Date", "lat"]).select("event_id", "label", "name")


@query(_ENTRIES + "SELECT event_id, label, name FROM f WHERE lower(label) LIKE 'gps%' OR lower(label) LIKE 'ex%'")
def group_filter(spark, sf_dir):
    return tags.selected(_entries(spark, sf_dir), everything=True, groups=["gps", "EX"]).select("event_id", "label", "name")


@query(_ENTRIES + "SELECT event_id, name, CASE WHEN kind = 'Sensitive' THEN '<redacted>' ELSE tag::VARCHAR END AS shown, CASE WHEN kind IS DISTINCT FROM 'Sensitive' THEN tag END AS raw FROM f")
def redacted_view(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("shown", c("tag").cast("string")).withColumn("raw", c("tag"))
    return tags.redacted(e, c("kind"), ["raw"], "shown").select("event_id", "name", "shown", "raw")


_ENUM_NAMES = ("Orientation", "Compression", "Flash", "CalibrationIlluminant1", "NoSuchName")


@query(f"""WITH dim(name, value, txt) AS (VALUES {_values(dictionaries.enum_rows())}),
o AS (SELECT o_orderkey, ([{", ".join(f"'{n}'" for n in _ENUM_NAMES)}])[(o_orderkey % 5 + 1)::INT] AS name, o_custkey % 27 AS value FROM orders)
SELECT o_orderkey, o.name, o.value, CASE WHEN txt IS NULL THEN o.value::VARCHAR ELSE txt || ' (' || o.value || ')' END AS shown FROM o LEFT JOIN dim ON o.name = dim.name AND o.value = dim.value""")
def enum_text(spark, sf_dir):
    name = F.element_at(F.array(*(lit(n) for n in _ENUM_NAMES)), (c("o_orderkey") % 5 + 1).cast("int"))
    return tags.with_enum_text(table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"), (c("o_custkey") % 27).alias("value")))


_FACETS = ("click", "view", "purchase", "signup")


@query("SELECT user_id, " + ", ".join(f"min_by(trim(props), (ts, event_id)) FILTER (event_type = '{n}' AND trim(props) <> '') AS {n}" for n in _FACETS) + " FROM events GROUP BY user_id")
def facet_pivot(spark, sf_dir):
    return tags.first_values(table(spark, sf_dir, "events"), "user_id", "event_type", "props", ["ts", "event_id"], list(_FACETS))


@query("SELECT user_id, min(event_id) AS copy_no, min_by(props, event_id) AS content FROM events WHERE event_id % 3 = 0 GROUP BY user_id")
def first_intact_copy(spark, sf_dir):
    digest = F.when(c("event_id") % 3 == 0, F.sha2("props", 256)).otherwise(lit("damaged"))
    copies = table(spark, sf_dir, "events").withColumn("digest", digest)
    return integrity.first_intact(copies, "user_id", "event_id", "props", "digest")


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag"]


def _runs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("len", c("l_quantity").cast("long"))
    return layout.run_offsets(li, "l_orderkey", _ORDER, "len").select(c("l_orderkey").alias("o"), "l_linenumber", "l_partkey", c("start").cast("long").alias("start"), "len")


_RUNS = f"""WITH r AS (SELECT l_orderkey AS o, l_linenumber, l_partkey, l_quantity::BIGINT AS len,
coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem),
p AS (SELECT o_orderkey AS o, o_custkey % 150 AS pos FROM orders)
"""


def _points(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("o"), (c("o_custkey") % 150).alias("pos"))


@query(_RUNS + "SELECT o, l_linenumber, l_partkey, start, len FROM r")
def run_offsets(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(_RUNS + "SELECT p.o, p.pos, r.start, r.len, r.l_partkey FROM p JOIN r ON p.o = r.o AND pos >= start AND pos < start + len")
def point_in_run(spark, sf_dir):
    return lookups.point_in_run(_points(spark, sf_dir), _runs(spark, sf_dir).select("o", "start", "len", "l_partkey"), "o", "pos", 64)


@query(_RUNS + "SELECT p.o, p.pos, min(r.start) AS next_start FROM p LEFT JOIN r ON p.o = r.o AND r.start > p.pos GROUP BY ALL")
def next_run(spark, sf_dir):
    return lookups.next_run(_points(spark, sf_dir), _runs(spark, sf_dir), "o", "pos")


@query("""WITH b AS (SELECT l_orderkey AS o, sum(l_quantity::BIGINT)::BIGINT AS stored FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey)
SELECT o_orderkey AS o, coalesce(stored, 0) AS stored, CASE WHEN stored IS NULL THEN 'missing' ELSE 'ok' END AS status FROM orders LEFT JOIN b ON o_orderkey = b.o""")
def segment_blob_join(spark, sf_dir):
    blobs = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").groupBy(c("l_orderkey").alias("o")).agg(F.sum(c("l_quantity").cast("long")).alias("stored"))
    return lookups.stored_segments(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("o")), blobs, ["o"], strict=True)


@query("""WITH b AS (SELECT l_orderkey AS o, sum(l_quantity::BIGINT)::BIGINT AS stored FROM lineitem WHERE l_orderkey % 4 <> 0 GROUP BY l_orderkey)
SELECT o_orderkey AS o, coalesce(stored, 0) AS stored, 'ok' AS status FROM orders LEFT JOIN b ON o_orderkey = b.o""")
def segment_blob_tolerant(spark, sf_dir):
    blobs = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 <> 0").groupBy(c("l_orderkey").alias("o")).agg(F.sum(c("l_quantity").cast("long")).alias("stored"))
    return lookups.stored_segments(table(spark, sf_dir, "orders").select(c("o_orderkey").alias("o")), blobs, ["o"], strict=False)


_PLACES = """WITH p AS (SELECT c_custkey AS k, (c_custkey * 7919 % 18000) / 100.0::DOUBLE - 90 AS lat, (c_custkey * 104729 % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer),
t AS (SELECT s_name AS city, s_nationkey::VARCHAR AS country, (s_suppkey * 6151 % 18000) / 100.0::DOUBLE - 90 AS lat, (s_suppkey * 75011 % 36000) / 100.0::DOUBLE - 180 AS lon, (s_suppkey * 977 % 1000 + 1) * 1000 AS population FROM supplier),
h AS (SELECT k, city, country, population, 2 * 6371.0088 * asin(sqrt(pow(sin(radians(t.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(t.lat)) * pow(sin(radians(t.lon - p.lon) / 2), 2))) AS km FROM p JOIN t ON abs(t.lat - p.lat) <= 1500 / 111.0::DOUBLE),
i AS (SELECT *, first(km) OVER w AS km0, first(population) OVER w AS pop0 FROM h WHERE km <= 1500 WINDOW w AS (PARTITION BY k ORDER BY km, city, country)),
j AS (SELECT *, km <= km0 + 8 AND population >= 4 * pop0 AS notable FROM i),
best AS (SELECT k, city, country, km FROM j QUALIFY row_number() OVER (PARTITION BY k ORDER BY notable DESC, CASE WHEN notable THEN population ELSE 0 END DESC, km, city DESC, country DESC) = 1)
"""


def _nearest(spark, sf_dir, odd: bool = False) -> DataFrame:
    def at(key: str, a: int, b: int) -> list[Column]:
        return [((c(key) * a % 18000) / 100.0 - 90).alias("lat"), ((c(key) * b % 36000) / 100.0 - 180).alias("lon")]

    points = table(spark, sf_dir, "customer").select(c("c_custkey").alias("k"), *at("c_custkey", 7919, 104729))
    places = table(spark, sf_dir, "supplier").select(c("s_name").alias("city"), c("s_nationkey").cast("string").alias("country"), *at("s_suppkey", 6151, 75011), ((c("s_suppkey") * 977 % 1000 + 1) * 1000).alias("population"))
    if odd:
        points = points.withColumn("lat", F.when(c("k") % 5 == 0, c("lat") + 200).otherwise(c("lat"))).withColumn("lon", F.when(c("k") % 5 == 1, lit(float("nan"))).otherwise(c("lon")))
    return lookups.nearest_place(points, places, "k", 1500.0)


@query(_PLACES + "SELECT k, city, country, round(km, 4) AS km FROM best")
def nearest_city(spark, sf_dir):
    return _nearest(spark, sf_dir).withColumn("km", F.round("km", 4))


@query(_PLACES.replace("FROM customer)", "FROM customer WHERE c_custkey % 5 > 1)") + "SELECT k, city, country, round(km, 4) AS km FROM best")
def nearest_of_sane_points(spark, sf_dir):
    """Points off the globe or without numbers have no place."""
    return _nearest(spark, sf_dir, odd=True).withColumn("km", F.round("km", 4))


@query(_PLACES + "SELECT k, CASE WHEN km < 5 THEN city || ', ' || country ELSE 'near ' || city || ', ' || country || printf(' (%.0f km)', km) END AS shown FROM best")
def nearest_label(spark, sf_dir):
    return _nearest(spark, sf_dir).select("k", formats.nearest_label(c("city"), c("country"), c("km")).alias("shown"))


@query("""SELECT c_custkey, round((c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey % 3599) / 100.0::DOUBLE / 3600.0::DOUBLE) * CASE WHEN c_nationkey % 4 IN (1, 3) THEN -1 ELSE 1 END, 6) AS decimal_degrees FROM customer""")
def dms_to_decimal(spark, sf_dir):
    ref = F.element_at(F.array(*(lit(x) for x in ("N", " s ", "e", "W"))), (c("c_nationkey") % 4 + 1).cast("int"))
    value = formats.dms_to_decimal(c("c_custkey") % 90, c("c_custkey") % 60, (c("c_custkey") % 3599) / 100.0, ref)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(value, 6).alias("decimal_degrees"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not a date' ELSE strftime(ts, '%A ') || day(ts) || ' ' || strftime(ts, '%B ') || year(ts) || strftime(ts, ', %H:%M') END AS shown FROM events""")
def human_date(spark, sf_dir):
    iso = F.when(c("event_id") % 7 == 0, lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", formats.human_date(iso).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders""")
def iso_date(spark, sf_dir):
    exif = F.when(c("o_orderkey") % 5 == 0, c("o_orderpriority")).otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", formats.iso_date(exif).alias("iso"))


_SIDES = "SELECT p_partkey, p_partkey * 37 % 9000 AS w, CASE WHEN p_partkey % 3 = 0 THEN p_partkey * 37 % 9000 * 2 // 3 ELSE p_partkey * 53 % 7000 END AS h FROM part"


def _sides(spark, sf_dir) -> DataFrame:
    k = c("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (k * 37 % 9000).alias("w"), F.expr("case when p_partkey % 3 = 0 then (p_partkey * 37 % 9000 * 2) div 3 else p_partkey * 53 % 7000 end").alias("h"))


@query(f"WITH s AS ({_SIDES}), r AS (SELECT *, greatest(w, h)::DOUBLE / nullif(least(w, h), 0)::DOUBLE AS r FROM s) SELECT p_partkey, CASE WHEN w = 0 OR h = 0 THEN '' "
       + " ".join(f"WHEN abs(r - {a}.0::DOUBLE / {b}) / ({a}.0::DOUBLE / {b}) < 0.005::DOUBLE THEN CASE WHEN w >= h THEN '{a}:{b}' ELSE '{b}:{a}' END" for a, b in dictionaries.RATIOS)
       + " ELSE printf('%.2f:1', r) END AS ratio FROM r")
def aspect_ratio(spark, sf_dir):
    return _sides(spark, sf_dir).select("p_partkey", formats.aspect(c("w"), c("h")).alias("ratio"))


@query(f"SELECT p_partkey, CASE WHEN w * h < 1000000 THEN '' ELSE printf('%.1f MP', w * h / 1000000.0::DOUBLE) END AS mp FROM ({_SIDES})")
def megapixels(spark, sf_dir):
    return _sides(spark, sf_dir).select("p_partkey", formats.megapixels(c("w"), c("h")).alias("mp"))


@query(f"""SELECT p_partkey, CASE WHEN greatest(w, h) <= 512 THEN greatest(w, 1) ELSE greatest(floor(w * (512.0::DOUBLE / greatest(w, h)) + 0.5::DOUBLE), 1) END::BIGINT AS fit_w,
CASE WHEN greatest(w, h) <= 512 THEN greatest(h, 1) ELSE greatest(floor(h * (512.0::DOUBLE / greatest(w, h)) + 0.5::DOUBLE), 1) END::BIGINT AS fit_h FROM ({_SIDES})""")
def preview_fit(spark, sf_dir):
    w, h = formats.fit(c("w"), c("h"), 512)
    return _sides(spark, sf_dir).select("p_partkey", w.alias("fit_w"), h.alias("fit_h"))


_TRIM = "rtrim(rtrim(printf('%.{0}f', {1}), '0'), '.')"


@query(f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE l_partkey END AS n, l_suppkey * 7 % 500 AS d FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN d = 0 THEN n || '/0' WHEN n % d = 0 THEN (n // d)::VARCHAR WHEN n = 1 THEN '1/' || d ELSE {_TRIM.format(6, "n::DOUBLE / d")} END AS shown FROM q""")
def rational_display(spark, sf_dir):
    n, d = F.when(c("l_partkey") % 4 == 0, lit(1)).otherwise(c("l_partkey")), c("l_suppkey") * 7 % 500
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", formats.rational(n, d).alias("shown"))


@query("""WITH e AS (SELECT vec_id, round(embedding[1]::DOUBLE * 8, 3) AS v FROM embeddings)
SELECT vec_id, round(pow(2.0::DOUBLE, -v), 6) AS seconds, round(pow(2.0::DOUBLE, v / 2), 6) AS f_number FROM e""")
def apex_exposure(spark, sf_dir):
    v = F.round(F.element_at("embedding", 1).cast("double") * 8, 3)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(formats.apex_seconds(v), 6).alias("seconds"), F.round(formats.apex_f_number(v), 6).alias("f_number"))


@query(f"""WITH x AS (SELECT p_partkey, p_size / 64.0::DOUBLE + (p_partkey % 2) AS s FROM part)
SELECT p_partkey, CASE WHEN s > 0 AND s < 1 THEN printf('1/%.0f s', 1 / s) ELSE {_TRIM.format(4, "s")} || ' s' END AS shutter, 'f/' || {_TRIM.format(4, "s")} AS aperture, {_TRIM.format(4, "s")} || ' mm' AS focal FROM x""")
def exposure_display(spark, sf_dir):
    s = c("p_size") / lit(64.0) + c("p_partkey") % 2
    return table(spark, sf_dir, "part").select("p_partkey", formats.exposure(s).alias("shutter"), formats.f_number(s).alias("aperture"), formats.millimetres(s).alias("focal"))


def _grid(spark, sf_dir) -> DataFrame:
    """8 x 8 pixels of 0 to 255."""
    pixel = lambda x: F.floor((x.cast("double") + 1) * 127.5)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.greatest(pixel(x), lit(0)), lit(255))).alias("px"))


_GRID = "WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: least(greatest(floor((x::DOUBLE + 1) * 127.5::DOUBLE), 0), 255)::BIGINT) AS px FROM embeddings)\n"
_PLANE = "list_transform(range({0}), lambda i: px[((i // 4 * 2 + {1}) * 8 + i % 4 * 2 + {2} + 1)::INT])"


@query(_GRID + "SELECT vec_id, [" + ", ".join(_PLANE.format(16, p // 2, p % 2) for p in range(4)) + "] AS planes FROM g")
def cfa_split(spark, sf_dir):
    return _grid(spark, sf_dir).select("vec_id", pixels.cfa_split(c("px"), 8, 8).alias("planes"))


@query(_GRID + "SELECT vec_id, px FROM g")
def cfa_merge(spark, sf_dir):
    planes = _grid(spark, sf_dir).select("vec_id", pixels.cfa_split(c("px"), 8, 8).alias("planes"))
    return planes.select("vec_id", pixels.cfa_merge(c("planes"), 8, 8).alias("px"))


@query(_GRID + """, e AS (SELECT vec_id, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM g),
o AS (SELECT y, x, y * 8 // 3 AS y0, ((y + 1) * 8 + 2) // 3 AS y1, x * 8 // 3 AS x0, ((x + 1) * 8 + 2) // 3 AS x1 FROM (SELECT unnest(range(3)) AS y), (SELECT unnest(range(3)) AS x))
SELECT vec_id, y * 3 + x AS at, round(avg(v), 6) AS mean FROM e JOIN o ON i // 8 >= y0 AND i // 8 < y1 AND i % 8 >= x0 AND i % 8 < x1 GROUP BY ALL""")
def area_downscale(spark, sf_dir):
    out = _grid(spark, sf_dir).select("vec_id", F.posexplode(pixels.area_average(c("px"), 8, 8, 3, 3)).alias("at", "mean"))
    return out.select("vec_id", c("at").cast("long").alias("at"), F.round("mean", 6).alias("mean"))


_MOVED = {1: ("y", "x"), 2: ("y", "7-x"), 3: ("7-y", "7-x"), 4: ("7-y", "x"), 5: ("x", "y"), 6: ("7-x", "y"), 7: ("7-x", "7-y"), 8: ("x", "7-y")}


@query(_GRID + " UNION ALL ".join(f"SELECT vec_id, {k} AS orientation, list_transform(range(64), lambda i: px[(({a.replace('y', 'i // 8').replace('x', 'i % 8')}) * 8 + ({b.replace('y', 'i // 8').replace('x', 'i % 8')}) + 1)::INT]) AS px FROM g" for k, (a, b) in _MOVED.items()))
def orient_8(spark, sf_dir):
    every = F.array(*(F.struct(lit(k).alias("orientation"), pixels.oriented(c("px"), 8, 8, k).alias("px")) for k in range(1, 9)))
    return _grid(spark, sf_dir).select("vec_id", F.explode(every).alias("o")).select("vec_id", "o.orientation", "o.px")


@query("""WITH e AS (SELECT vec_id, least(greatest((embedding[1]::DOUBLE + 1) / 2, 0), 1) AS v, (embedding[2]::DOUBLE + 1) * 2 AS y FROM embeddings), p AS (SELECT *, pow(v, 1 / 78.84375::DOUBLE) AS q FROM e)
SELECT vec_id, round(CASE WHEN v <= 0.04045::DOUBLE THEN v / 12.92::DOUBLE ELSE pow((v + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END, 6) AS srgb,
round(CASE WHEN 18.851562::DOUBLE - 18.6875::DOUBLE * q <= 0 THEN 0 ELSE pow(greatest(q - 0.8359375::DOUBLE, 0) / (18.851562::DOUBLE - 18.6875::DOUBLE * q), 1 / 0.15930176::DOUBLE) * (10000 / 203.0::DOUBLE) END, 6) AS pq,
round(CASE WHEN v <= 0.5 THEN v * v / 3 ELSE (exp((v - 0.5599107::DOUBLE) / 0.17883277::DOUBLE) + 0.28466892::DOUBLE) / 12 END / 0.2649006::DOUBLE, 6) AS hlg,
round(CASE WHEN y <= 0.8 THEN 1 ELSE (0.8::DOUBLE + 0.2::DOUBLE * (1 - exp(-(y - 0.8::DOUBLE) / 0.2::DOUBLE))) / y END, 6) AS gain FROM p""")
def tone_curve(spark, sf_dir):
    v, y = colour.clamp((F.element_at("embedding", 1).cast("double") + 1) / 2), (F.element_at("embedding", 2).cast("double") + 1) * 2
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(colour.srgb_to_linear(v), 6).alias("srgb"), F.round(colour.pq_to_linear(v), 6).alias("pq"), F.round(colour.hlg_to_linear(v), 6).alias("hlg"), F.round(colour.tone_gain(y), 6).alias("gain"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'FAILED' WHEN doc_id % 2 = 0 THEN 'ok (quick)' ELSE 'ok (full)' END AS verdict FROM documents JOIN labels USING (doc_id)""")
def verify_verdicts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    digest = F.sha2("text", 256)
    found = F.when(c("toxic") == 1, lit("damaged")).otherwise(digest)
    n = F.octet_length("text")
    return d.select("doc_id", integrity.verdict(n, n, found, digest, c("doc_id") % 2 == 0).alias("verdict"))


@query(_GRID + ", x AS (SELECT vec_id, list_concat(px, px)[1:(vec_id % 80 + 1)::INT] AS v FROM g) SELECT vec_id, len(v) AS n_values, CASE WHEN len(v) <= 64 THEN '[' || array_to_string(v, ',') || ']' END AS raw FROM x")
def json_raw(spark, sf_dir):
    """Lists of up to 64 values as JSON; longer ones are left out."""
    e = _grid(spark, sf_dir).select("vec_id", F.slice(F.concat("px", "px"), 1, (c("vec_id") % 80 + 1).cast("int")).alias("v"))
    return e.select("vec_id", F.size("v").alias("n_values"), export.capped(c("v")).alias("raw"))


@query(f"""SELECT vec_id, array_to_string(list_transform(embedding[1:k], lambda x: {_TRIM.format(6, "x::DOUBLE")})[1:8], ', ') || CASE WHEN k > 8 THEN ' ⋯ (' || k || ' values)' ELSE '' END AS shown
FROM (SELECT *, vec_id % 16 + 1 AS k FROM embeddings)""")
def render_truncated(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, (c("vec_id") % 16 + 1).cast("int")), lambda x: x.cast("double"))
    value = F.struct(lit("reals").alias("tag"), v.alias("reals"), lit(None).cast("array<struct<n:bigint,d:bigint>>").alias("rats"))
    entries = table(spark, sf_dir, "embeddings").select("vec_id", value.alias("value"))
    return facets.shown_numbers(entries, ["vec_id"]).withColumnRenamed("numbers", "shown")


@query("SELECT l_orderkey, max(l_quantity) AS peak, sum(l_quantity) AS total, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_large FROM lineitem GROUP BY l_orderkey")
def peak_metrics(spark, sf_dir):
    return stats.peaks(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_quantity", any_of={"any_returned": c("l_returnflag") == "R"}, all_of={"all_large": c("l_quantity") > 5})


def _kernel(docs: DataFrame, work, schema: str) -> DataFrame:
    """Rows of work(doc_id, bytes of the text), for byte kernels that SQL has no word for."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]

    def run(batches):
        for b in batches:
            rows = [r for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True) for r in work(i, t or b"")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


@query()
def reed_solomon_roundtrip(spark, sf_dir):
    """Two of six shards of every document are lost and made again."""
    def work(doc_id, data):
        import numpy as np

        from ..functions import gf256

        size = max(-(-len(data) // 4), 1)
        shards = np.zeros((4, size), np.uint8)
        shards.reshape(-1)[: len(data)] = np.frombuffer(data, np.uint8)
        every = np.concatenate([shards, gf256.parity(shards, 2)])
        good = np.ones(6, bool)
        good[[doc_id % 6, (doc_id * 5 + 1) % 6]] = False
        broken = np.where(good[:, None], every, np.uint8(0xA5))
        yield doc_id, int((~good).sum()), bool((gf256.repaired(broken, good, 4) == every).all())

    return _kernel(table(spark, sf_dir, "documents"), work, "doc_id long, lost long, repaired boolean")


@query("SELECT doc_id, strlen(text) AS original, sha256(text) AS digest, 'ok (full)' AS verdict, true AS repaired FROM documents")
def archive_roundtrip(spark, sf_dir):
    """Every document is archived with parity, damaged, repaired and given back."""
    def work(doc_id, data):
        import hashlib

        from ..archive import format as fmt

        raw = fmt.pack(data, str(doc_id), "zlib", fmt.Parity(4, 2, 1024))
        broken = bytearray(raw)
        broken[len(raw) // 5] ^= 0xFF
        mended = fmt.repair(bytes(broken))
        back, want = fmt.unpack(mended), fmt.manifest(mended)["original"]
        yield doc_id, len(back), hashlib.sha256(back).hexdigest(), want["len"], want["sha256"], mended == raw

    found = _kernel(table(spark, sf_dir, "documents"), work, "doc_id long, original long, digest string, want_len long, want string, repaired boolean")
    return found.select("doc_id", "original", "digest", integrity.verdict(c("original"), c("want_len"), c("digest"), c("want"), lit(False)).alias("verdict"), "repaired")


_RANGE = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 14 ELSE 16 END AS bits, p_size % 4 AS fmt, p_partkey % 3 = 0 AS raw, p_partkey % 11 AS turn FROM part"


@query(f"""SELECT p_partkey, CASE WHEN fmt = 3 THEN 'floating point, scene-linear, unbounded' WHEN raw AND bits >= 12 THEN 'high, ' || bits || '-bit linear sensor data' WHEN bits = 8 THEN 'standard, 8-bit, display-referred' END AS dynamic,
CASE WHEN turn BETWEEN 1 AND 8 THEN turn ELSE 1 END AS orientation FROM ({_RANGE})""")
def dynamic_range(spark, sf_dir):
    k = c("p_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, 8).when(k % 4 == 1, 12).when(k % 4 == 2, 14).otherwise(16).alias("bits"), (c("p_size") % 4).alias("fmt"), (k % 3 == 0).alias("raw"), (k % 11).alias("turn"))
    return part.select("p_partkey", formats.dynamic_range(c("bits"), c("fmt"), c("raw")).alias("dynamic"), formats.orientation(c("turn")).alias("orientation"))


@query("""SELECT c_custkey, CASE WHEN starts_with(lower(model), lower(make)) THEN model ELSE make || ' ' || model END AS camera
FROM (SELECT c_custkey, c_mktsegment AS make, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) || ' X' ELSE c_name END AS model FROM customer)""")
def camera_name(spark, sf_dir):
    model = F.when(c("c_custkey") % 2 == 0, F.concat(F.lower("c_mktsegment"), lit(" X"))).otherwise(c("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", formats.camera_name(c("c_mktsegment"), model).alias("camera"))


@query("""WITH t AS (SELECT doc_id, strlen(text) AS n, (doc_id % 50) / 1000.0::DOUBLE AS s FROM documents), r AS (SELECT *, CASE WHEN s > 0 THEN floor(n / s) END::BIGINT AS rate FROM t)
SELECT doc_id, CASE WHEN s < 0.005::DOUBLE THEN '—' WHEN rate < 1024 THEN rate || ' B/s' WHEN rate < 1048576 THEN printf('%.1f KB/s', rate / 1024.0::DOUBLE) ELSE printf('%.1f MB/s', rate / 1048576.0::DOUBLE) END AS shown FROM r""")
def throughput(spark, sf_dir):
    return objects(spark, sf_dir).select("doc_id", formats.throughput(c("total_len"), (c("doc_id") % 50) / 1000.0).alias("shown"))


@query("""WITH e AS (SELECT p_partkey, floor(p_size / 50.0::DOUBLE * 80 + 0.5::DOUBLE)::INT AS e FROM part)
SELECT p_partkey, rpad(repeat('█', e // 8) || CASE WHEN e % 8 > 0 THEN substr('▏▎▍▌▋▊▉', e % 8, 1) ELSE '' END, 10, '·') AS bar FROM e""")
def proportion_bar(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", formats.bar(c("p_size") / 50.0, 10).alias("bar"))


@query("""SELECT user_id, event_id, event_type, value > coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raised FROM events""")
def peak_phase(spark, sf_dir):
    """Which step raised the highest value so far."""
    steps = stats.raised(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return steps.select("user_id", "event_id", "event_type", "raised")


@query(_SEGMENTS + "SELECT doc_id, seg_no, len, kind FROM seg WHERE kind = 'image' AND len >= 400")
def image_filter(spark, sf_dir):
    return segments(spark, sf_dir).where("kind = 'image' and len >= 400").select("doc_id", "seg_no", "len", "kind")
