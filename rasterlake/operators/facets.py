"""From entries to what a reader sees: fields with display values, and a file's summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..sources import icc
from . import lookups, tags

MOST_ITEMS = 8
#: Directories in the order in which their values count.
ORDER = ["ifd_ord", "ent_ord"]
SUMMARY = ("Make", "Model", "LensModel", "DateTimeOriginal", "DateTime", "ExposureTime", "ShutterSpeedValue", "FNumber", "ApertureValue", "ISOSpeedRatings", "FocalLength", "FocalLengthIn35mmFilm", "ExposureProgram", "Flash", "WhiteBalance", "ColorSpace", "Orientation", "Software", "Artist", "Copyright", "ImageWidth", "ImageLength")


def first_number(value: Column) -> Column:
    """A value's first element as a number; null for a fraction over 0."""
    r = F.try_element_at(value["rats"], F.lit(1))
    return F.coalesce(F.try_element_at(value["ints"], F.lit(1)).cast("double"), F.try_element_at(value["reals"], F.lit(1)), F.try_divide(r["n"].cast("double"), r["d"].cast("double")))


def rendered(value: Column, most: int = MOST_ITEMS) -> Column:
    """Any value as one line."""
    ints = formats.rendered(F.transform(value["ints"], lambda x: x.cast("string")), most)
    return F.when(value["tag"] == "text", value["text"]).when(value["tag"] == "ints", ints).when(value["tag"] == "binary", F.concat(F.lit("<binary, "), formats.human_bytes(value["bin_len"]), F.lit(">"))).when(value["tag"] == "unreadable", F.concat(F.lit("<unreadable: "), value["why"], F.lit(">")))


def shown_numbers(entries: DataFrame, key: list[str], most: int = MOST_ITEMS) -> DataFrame:
    """(key, numbers) of entries whose value is a list of fractions or reals: the first `most`, and how many there are.

    Numbers are formatted row by row of an exploded list, and only as many as are shown.
    """
    v = F.col("value")
    size = F.size(F.when(v["tag"] == "rats", F.transform(v["rats"], lambda r: F.lit(1))).otherwise(F.transform(v["reals"], lambda x: F.lit(1))))
    nothing = lambda kind: F.lit(None).cast(kind)
    rats = F.transform(F.slice(v["rats"], 1, most), lambda r: F.struct(r["n"].alias("n"), r["d"].alias("d"), nothing("double").alias("x")))
    reals = F.transform(F.slice(v["reals"], 1, most), lambda x: F.struct(nothing("bigint").alias("n"), nothing("bigint").alias("d"), x.alias("x")))
    rows = entries.where("value.tag in ('rats', 'reals')").select(*key, size.alias("__size"), F.posexplode(F.when(v["tag"] == "rats", rats).otherwise(reals)).alias("__i", "__x"))
    one = F.when(F.col("__x.x").isNull(), formats.rational(F.col("__x.n"), F.col("__x.d"))).otherwise(formats.without_zeros(formats.decimals(F.col("__x.x"), F.lit(6))))
    shown = rows.withColumn("__s", one).groupBy(*key, "__size").agg(F.array_sort(F.collect_list(F.struct("__i", "__s"))).alias("__s"))
    text = F.array_join(F.transform("__s", lambda x: x["__s"]), ", ")
    return shown.select(*key, F.when(F.col("__size") > most, F.concat(text, F.lit(" ⋯ ("), F.col("__size").cast("string"), F.lit(" values)"))).otherwise(text).alias("numbers"))


def fields(entries: DataFrame, *, everything: bool = False, redact: bool = False, groups: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
    """Entries with name, kind, label and display, as selected; matrix: nine fractions as three lines."""
    e = tags.selected(tags.with_names(entries.where("status = 'ok'")), everything=everything, groups=groups, tags=names)
    key = ["path", "ifd_ord", "ent_ord"]
    v = F.col("value")
    e = e.join(shown_numbers(e, key), key, "left").withColumn("number", first_number(F.col("value")))
    e = tags.with_enum_text(e.withColumn("whole", F.col("number").cast("bigint")), "name", "whole").withColumnRenamed("shown", "enum_text")
    plain = F.coalesce("numbers", rendered(F.col("value")))
    kind, known = F.col("kind"), F.col("number").isNotNull()
    opaque = F.when(v["tag"] == "binary", F.concat(F.lit("<opaque, "), formats.human_bytes(v["bin_len"]), F.lit(">"))).when((v["tag"] == "text") & (F.octet_length(v["text"]) <= 32), v["text"]).otherwise(F.concat(F.lit("<opaque, "), F.col("count").cast("string"), F.lit(" values>")))
    display = (
        F.when(v["tag"] == "unreadable", plain).when((kind == "Seconds") & known, formats.exposure(F.col("number"))).when((kind == "FNumber") & known, formats.f_number(F.col("number")))
        .when((kind == "Millimetres") & known, formats.millimetres(F.col("number"))).when((kind == "Iso") & known, F.concat(F.lit("ISO "), F.col("whole").cast("string"))).when((kind == "Enum") & known, F.col("enum_text"))
        .when(kind == "Opaque", opaque).when((kind == "DateTime") & (v["tag"] == "text"), formats.iso_date(v["text"])).otherwise(plain)
    )
    hidden = F.coalesce(kind == "Sensitive", F.lit(False)) & F.lit(redact)
    out = e.select(*key, "container", "little_endian", "ifd_kind", "label", "ifd_offset", "tag", "name", "kind", "dtype", "count", "value_offset", formats.type_note(F.col("dtype"), F.col("count")).alias("type_note"), "value", F.col("number"), display.alias("display"), formats.matrix_rows(v["rats"]).alias("matrix"), hidden.alias("redacted"))
    return tags.redacted(out, F.col("kind"), ["value", "number", "matrix"], "display") if redact else out


def _degrees(which: str) -> Column:
    """Decimal degrees of a coordinate's three fractions and its hemisphere."""
    part = lambda i: F.coalesce(F.try_divide(F.try_element_at(F.col(which)["rats"], F.lit(i))["n"].cast("double"), F.try_element_at(F.col(which)["rats"], F.lit(i))["d"].cast("double")), F.lit(0.0))
    return F.when(F.size(F.col(which)["rats"]) >= 3, formats.dms_to_decimal(part(1), part(2), part(3), F.col(f"{which}Ref")["text"]))


def summary(found: DataFrame) -> DataFrame:
    """One row a file: the first value of each name that a summary shows, and what follows from them."""
    s = tags.first_values(found.withColumn("display", F.coalesce("display", F.lit(""))), "path", "name", "display", ORDER, list(SUMMARY))
    gps = found.where("ifd_kind = 'Gps'").groupBy("path").agg(*(F.min_by(F.when(F.col("name") == n, F.col("value")), F.when(F.col("name") == n, F.struct(*ORDER))).alias(n) for n in ("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")))

    gps = gps.select("path", _degrees("GPSLatitude").alias("lat"), _degrees("GPSLongitude").alias("lon"))
    w, h = F.col("ImageWidth").try_cast("bigint"), F.col("ImageLength").try_cast("bigint")
    s = s.join(gps, "path", "left")
    return s.withColumns({"camera": formats.camera_name(F.col("Make"), F.col("Model")), "taken": formats.human_date(F.coalesce("DateTimeOriginal", "DateTime")), "aspect": formats.aspect(w, h), "megapixels": formats.megapixels(w, h)})


#: What a summary tells, in this order.
FACETS = ("Camera", "Lens", "Shutter", "Aperture", "ISO", "Flash", "Taken", "Where", "Format", "Image", "Aspect", "Depth", "Dynamic", "Colour", "Sensor", "Rotation", "Software", "Author")
_SENSITIVE = ("Where", "Author")
#: How far a place may be to be named.
PLACE_KM = 150.0
_TEXTS = ("Make", "Model", "UniqueCameraModel", "LensModel", "FocalLength", "FocalLengthIn35mmFilm", "ExposureTime", "ExposureProgram", "FNumber", "ISOSpeedRatings", "ISOSpeed", "Flash", "DateTimeOriginal", "DateTime", "ColorSpace", "BlackLevel", "WhiteLevel", "DefaultCropSize", "Orientation", "Software", "Artist", "Copyright", "CameraOwnerName")
_IMAGE_NUMBERS = ("ImageWidth", "ImageLength", "BitsPerSample", "SampleFormat")


def facet_rows(found: DataFrame, places: DataFrame | None = None, profiles: DataFrame | None = None) -> DataFrame:
    """(path, ord, facet, parts, sensitive): what each file's fields tell, in a fixed order; facets with nothing to say have no row.

    places: cities for nearest_place(). profiles: path and profile (the struct of sources.icc).
    Values of images come from the first sub-directory, else the main one, which is a raw file's preview.
    """
    c, order = F.col, F.struct(*ORDER)
    filled = F.nullif(F.trim("display"), F.lit("")).isNotNull()
    first = lambda value, where: F.min_by(value, F.when(where, order))
    image = c("label").isin("SubIFD0", "IFD0")
    best = lambda value, name, where: F.min_by(value, F.when((c("name") == name) & image & where, F.struct((c("label") != "SubIFD0").alias("other"), *ORDER)))
    w = found.groupBy("path").agg(
        F.first("container").alias("container"), F.first("little_endian").alias("little_endian"),
        *(first(F.trim("display"), (c("name") == n) & filled).alias(n) for n in _TEXTS),
        *(first(c("number"), (c("name") == n) & c("number").isNotNull()).alias(n) for n in ("ShutterSpeedValue", "ApertureValue", "PixelXDimension", "PixelYDimension")),
        *(best(c("number"), n, c("number").isNotNull()).alias(n) for n in _IMAGE_NUMBERS),
        *(best(F.trim("display"), n, filled).alias(n) for n in ("PhotometricInterpretation", "Compression")),
        *(first(c("value"), (c("name") == n) & (c("ifd_kind") == "Gps")).alias(n) for n in ("GPSLatitude", "GPSLongitude", "GPSLatitudeRef", "GPSLongitudeRef")),
        F.bool_or((c("name") == "GPSLatitude") & c("redacted")).alias("hidden"), F.bool_or(c("name") == "ColorMatrix1").alias("matrix"), F.bool_or(c("name") == "InterColorProfile").alias("profiled"),
    )
    w = w.withColumns({"lat": _degrees("GPSLatitude"), "lon": _degrees("GPSLongitude")})
    near = F.lit(None).cast("string")
    if places is not None:
        at = lookups.nearest_place(w.where("lat is not null and lon is not null"), places, "path", PLACE_KM)
        w, near = w.join(at, "path", "left"), formats.nearest_label(c("city"), c("country"), c("km"))
    profile = F.lit(None).cast(icc.SCHEMA)
    if profiles is not None:
        w, profile = w.join(profiles.select("path", c("profile").alias("__icc")), "path", "left"), c("__icc")
    word = lambda x: F.split_part(x, F.lit(" ("), F.lit(1))
    width, height = (F.coalesce(c(a), c(b)).cast("bigint") for a, b in (("ImageWidth", "PixelXDimension"), ("ImageLength", "PixelYDimension")))
    bits, photometric, packed = c("BitsPerSample").cast("bigint"), word(c("PhotometricInterpretation")), word(c("Compression"))
    raw = F.coalesce(photometric.startswith("CFA") | photometric.startswith("linear raw"), F.lit(False))
    inner = F.regexp_replace("container", "^archive of ", "")
    program = word(c("ExposureProgram"))
    described = F.when(profile["description"].isNotNull(), F.concat(F.lit("ICC: "), profile["description"])).when(profile["transfer"].isNotNull(), F.concat(F.lit("ICC: "), profile["primaries"], F.lit(", "), profile["transfer"])).when(profile["version"].isNotNull(), F.lit("ICC profile embedded")).when(c("profiled"), F.lit("ICC profile embedded (unreadable)"))
    known = width.isNotNull() & height.isNotNull()
    coords = F.concat(formats.degrees_text(c("lat"), "N", "S"), F.lit(", "), formats.degrees_text(c("lon"), "E", "W"))
    shutter = F.coalesce(c("ExposureTime"), formats.apex_shutter_text(c("ShutterSpeedValue")))
    parts = {
        "Camera": [formats.camera_name(c("Make"), F.coalesce("Model", "UniqueCameraModel"))],
        "Lens": [c("LensModel"), c("FocalLength"), F.when(~c("FocalLengthIn35mmFilm").eqNullSafe(F.coalesce("FocalLength", "LensModel")), F.concat("FocalLengthIn35mmFilm", F.lit(" equivalent")))],
        "Shutter": [shutter, F.when(shutter.isNotNull() & (program != "not defined"), program)],
        "Aperture": [F.coalesce(c("FNumber"), F.concat(F.lit("f/"), formats.decimals(formats.apex_f_number(c("ApertureValue")), F.lit(1))))],
        "ISO": [F.regexp_replace(F.coalesce("ISOSpeedRatings", "ISOSpeed"), "^(ISO )+", "")],
        "Flash": [F.when(~c("Flash").startswith("did not fire"), word(c("Flash")))],
        "Taken": [formats.human_date(F.coalesce("DateTimeOriginal", "DateTime"))],
        "Where": [F.when(c("hidden"), F.lit(tags.REDACTED)).otherwise(coords), F.when(~F.coalesce("hidden", F.lit(False)), near)],
        "Format": [F.when(c("container").startswith("archive"), F.lit("archive")), F.when(inner == "jpeg", "JPEG").when(raw, "TIFF/EP raw").otherwise("TIFF"), F.when((packed == "JPEG") & raw, "lossless JPEG (LJ92)").when(packed == "uncompressed", packed).otherwise(F.concat(packed, F.lit("-compressed"))), F.when(c("little_endian"), "little-endian").otherwise("big-endian")],
        "Image": [F.when(known, F.concat_ws(" × ", width, height)), F.when(known, formats.megapixels(width, height))],
        "Aspect": [F.when(known, formats.aspect(width, height)), F.when(known & (formats.aspect(width, height) != ""), F.when(height > width, "portrait").when(height < width, "landscape"))],
        "Depth": [F.concat(bits.cast("string"), F.lit("-bit "), F.when(c("SampleFormat") == 3, "floating point").when(c("SampleFormat") == 2, "signed integer").otherwise("integer")), F.when(bits.isNotNull(), photometric)],
        "Dynamic": [F.when(bits.isNotNull(), formats.dynamic_range(bits, c("SampleFormat"), raw, profile))],
        "Colour": [word(c("ColorSpace")), described, F.when(c("matrix"), "camera matrix present")],
        "Sensor": [F.concat(F.lit("black "), "BlackLevel"), F.concat(F.lit("white "), "WhiteLevel"), F.concat(F.lit("crop "), F.regexp_replace("DefaultCropSize", ", ", " × "))],
        "Rotation": [F.when(word(c("Orientation")) != "upright", word(c("Orientation")))],
        "Software": [c("Software")],
        "Author": [c("Artist"), c("Copyright"), c("CameraOwnerName")],
    }
    every = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(f).alias("facet"), F.filter(F.array(*(F.nullif(F.trim(x), F.lit("")) for x in parts[f])), lambda x: x.isNotNull()).alias("parts"), F.lit(f in _SENSITIVE).alias("sensitive")) for i, f in enumerate(FACETS)))
    return w.select("path", F.inline(every)).where(F.size("parts") > 0)
