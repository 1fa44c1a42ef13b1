"""Scalar functions as column expressions: display of sizes, fractions, dates, shapes and places.

Numbers are shown as C's printf does, from the exact binary value; Spark's own number formats round
the shortest decimal instead, so `decimals` goes through one Arrow batch function. All else is
built in and stays in generated code.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionaries import RATIOS, TYPES

UNITS = ("B", "KB", "MB", "GB", "TB")


@F.pandas_udf(T.StringType())
def decimals(value: pd.Series, places: pd.Series) -> pd.Series:
    """value with a number of decimals, ties to even on the exact value; null for null."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(p)}f}" for v, p in zip(value, places, strict=True)], dtype=object)


def _places(value: Column, n: int) -> Column:
    return decimals(value.cast("double"), F.lit(n))


def without_zeros(shown: Column) -> Column:
    """Without zeros after the point, and without a bare point."""
    return F.regexp_replace(F.regexp_replace(shown, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def human_bytes(n: Column) -> Column:
    """512 B, 4.0 KB, up to TB."""
    step = sum((F.when(n >= F.lit(float(1024**i)), 1).otherwise(0) for i in range(1, len(UNITS))), F.lit(0))
    scaled = n / F.pow(F.lit(1024.0), step)
    unit = F.element_at(F.array(*(F.lit(u) for u in UNITS)), step + 1)
    return F.when(step == 0, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(_places(scaled, 1), F.lit(" "), unit))


def rational(n: Column, d: Column) -> Column:
    """A fraction as shown: n/0, a whole number, 1/d, or up to six decimals."""
    return (
        F.when(d == 0, F.concat(n.cast("string"), F.lit("/0")))
        .when(n % F.nullif(d, F.lit(0)) == 0, F.round(F.try_divide(n.cast("double"), d.cast("double"))).cast("bigint").cast("string"))
        .when((n == 1) & (d > 1), F.concat(F.lit("1/"), d.cast("string")))
        .otherwise(without_zeros(_places(F.try_divide(n.cast("double"), d.cast("double")), 6)))
    )


def iso_date(s: Column) -> Column:
    """YYYY:MM:DD HH:MM:SS as ISO 8601; anything of another shape as it is."""
    fits = (F.octet_length(s) >= 19) & (F.substring(s, 5, 1) == ":") & (F.substring(s, 8, 1) == ":") & (F.substring(s, 11, 1) == " ")
    return F.when(fits, F.concat(F.substring(s, 1, 4), F.lit("-"), F.substring(s, 6, 2), F.lit("-"), F.substring(s, 9, 2), F.lit("T"), F.substring(s, 12, 8))).otherwise(s)


def human_date(iso: Column) -> Column:
    """Weekday, day, month, year and time; anything of another shape as it is.

    The day of the week is counted, not looked up in a calendar: 31 February has one too.
    """
    part = lambda a, n: F.substring(iso, a, n).try_cast("int")
    y, m, d = part(1, 4), part(6, 2), part(9, 2)
    fits = (F.octet_length(iso) >= 16) & (F.substring(iso, 5, 1) == "-") & (F.substring(iso, 8, 1) == "-") & (F.substring(iso, 11, 1) == "T") & m.between(1, 12) & d.between(1, 31) & y.isNotNull()
    # Days from 0000-03-01, in years that begin in March.
    year, month = y - (m < 3).cast("int"), F.pmod(m + 9, F.lit(12))
    days = year * 365 + F.floor(year / 4) - F.floor(year / 100) + F.floor(year / 400) + F.floor((month * 153 + 2) / 5) + d - 1
    names = F.array(*(F.lit(x) for x in ("Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "Monday", "Tuesday")))
    months = F.array(*(F.lit(x) for x in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")))
    shown = F.concat(F.try_element_at(names, (F.pmod(days, F.lit(7)) + 1).cast("int")), F.lit(" "), d.cast("string"), F.lit(" "), F.try_element_at(months, m), F.lit(" "), y.cast("string"), F.lit(", "), F.substring(iso, 12, 5))
    return F.when(fits, shown).otherwise(iso)


def aspect(w: Column, h: Column) -> Column:
    """The conventional ratio within half a percent, else a decimal; empty for an empty side."""
    ratio = F.try_divide(F.greatest(w, h).cast("double"), F.least(w, h).cast("double"))
    out = F.when((w == 0) | (h == 0), F.lit(""))
    for a, b in RATIOS:
        out = out.when(F.abs(ratio - a / b) / (a / b) < 0.005, F.when(w >= h, F.lit(f"{a}:{b}")).otherwise(F.lit(f"{b}:{a}")))
    return out.otherwise(F.concat(_places(ratio, 2), F.lit(":1")))


def megapixels(w: Column, h: Column) -> Column:
    mp = (w * h) / F.lit(1_000_000.0)
    return F.when(mp < 1, F.lit("")).otherwise(F.concat(_places(mp, 1), F.lit(" MP")))


def exposure(seconds: Column) -> Column:
    """1/n s below a second."""
    fast = F.concat(F.lit("1/"), _places(F.try_divide(F.lit(1.0), seconds), 0), F.lit(" s"))
    return F.when((seconds > 0) & (seconds < 1), fast).otherwise(F.concat(without_zeros(_places(seconds, 4)), F.lit(" s")))


def f_number(f: Column) -> Column:
    return F.concat(F.lit("f/"), without_zeros(_places(f, 4)))


def millimetres(f: Column) -> Column:
    return F.concat(without_zeros(_places(f, 4)), F.lit(" mm"))


def apex_seconds(v: Column) -> Column:
    return F.pow(F.lit(2.0), -v)


def apex_f_number(v: Column) -> Column:
    return F.pow(F.lit(2.0), v / 2)


def dms_to_decimal(deg: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Decimal degrees, negative for S and W."""
    value = deg + minutes / F.lit(60.0) + seconds / F.lit(3600.0)
    return F.when(F.upper(F.trim(ref)).isin("S", "W"), -value).otherwise(value)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def nearest_label(city: Column, country: Column, km: Column) -> Column:
    place = F.concat(city, F.lit(", "), country)
    return F.when(km < 5, place).otherwise(F.concat(F.lit("near "), place, F.lit(" ("), _places(km, 0), F.lit(" km)")))


def tag_label(tag: Column, name: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("Tag(0x"), F.lpad(F.hex(tag), 4, "0"), F.lit(")")))


def type_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for c, name, _ in TYPES:
        out = F.when(code == c, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def type_note(code: Column, count: Column) -> Column:
    """An entry's type and how many values it has: short[3]."""
    return F.concat(type_name(code), F.lit("["), count.cast("string"), F.lit("]"))


def matrix_rows(fractions: Column) -> Column:
    """Nine fractions as three lines of three numbers of six decimals; null for any other count."""
    number = F.transform(fractions, lambda r: F.when(r["d"] == 0, F.lit(0.0)).otherwise(r["n"].cast("double") / r["d"]))
    return F.when(F.size(fractions) == 9, _matrix(number))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _matrix(values: pd.Series) -> pd.Series:
    return pd.Series([None if v is None or len(v) != 9 else ["  ".join(f"{x:9.6f}" for x in v[i : i + 3]) for i in (0, 3, 6)] for v in values], dtype=object)


def dms_text(deg: Column, minutes: Column, seconds: Column) -> Column:
    """Degrees, minutes and seconds as 51\u00b030'0.00"."""
    return F.concat(_places(deg, 0), F.lit("\u00b0"), _places(minutes, 0), F.lit("'"), _places(seconds, 2), F.lit('"'))


def degrees_text(value: Column, positive: str, negative: str) -> Column:
    """Degrees without a sign: four decimals and the letter of the hemisphere."""
    return F.concat(_places(F.abs(value), 4), F.lit("\u00b0 "), F.when(value < 0, F.lit(negative)).otherwise(F.lit(positive)))


def utc_now() -> Column:
    """The time of the query in UTC, as 2026-01-31T12:00:00Z, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def holds(original: Column, derived: Column, archive: Column) -> Column:
    """The original's name where the archive's own name does not follow from it; empty where it does."""
    return F.when(derived == archive, F.lit("")).otherwise(original)


def overhead_percent(parity: Column, data: Column) -> Column:
    """Parity as a share of the data it protects, in percent."""
    return F.try_divide(parity.cast("double") * 100.0, data.cast("double"))


def apex_shutter_text(v: Column) -> Column:
    """Exposure of an APEX shutter value: whole tenths from one second on, else 1/n s."""
    s = apex_seconds(v)
    return F.when(s >= 1, F.concat(_places(s, 1), F.lit(" s"))).otherwise(F.concat(F.lit("1/"), _places(1 / s, 0), F.lit(" s")))


def rendered(items: Column, most: int = 8) -> Column:
    """The first items of an array of strings, and how many there are where some are left out."""
    shown = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(F.size(items) > most, F.concat(shown, F.lit(" ⋯ ("), F.size(items).cast("string"), F.lit(" values)"))).otherwise(shown)


def fit(w: Column, h: Column, edge: int) -> tuple[Column, Column]:
    """Sides with the longer one cut to edge; never larger than before, nor below 1."""
    longest = F.greatest(w, h)
    scale = F.try_divide(F.lit(float(edge)), longest.cast("double"))
    side = lambda x: F.when((longest <= edge) | (longest == 0), F.greatest(x, F.lit(1))).otherwise(F.greatest(F.floor(x * scale + 0.5), F.lit(1)))
    return side(w).cast("long"), side(h).cast("long")


def parity_plan(length: Column, data: int = 32, parity: int = 2, shard: int = 65_536, header: int = 26) -> dict[str, Column]:
    """Shards, stripes and parity bytes that protect a length."""
    if not 0 < data + parity <= 255 or data < 1 or parity < 1 or shard < 1 or shard % 64:
        raise ValueError("data and parity shards are 1 to 255 together, of a multiple of 64 bytes")
    shards = F.greatest(F.ceil(length / F.lit(shard)), F.lit(1)).cast("long")
    stripes = F.ceil(shards / F.lit(data)).cast("long")
    return {"shards": shards, "stripes": stripes, "parity_bytes": stripes * parity * shard, "section_len": (F.lit(header) + (shards + stripes * parity) * 4) * 2 + stripes * parity * shard}


def parity_for_percent(percent: int, data: int = 32) -> int | None:
    """Parity shards for a share of data, rounded up; None for none or too many."""
    shards = max(-(-data * percent // 100), 1)
    return shards if percent > 0 and data + shards <= 255 else None


def throughput(size: Column, seconds: Column) -> Column:
    """Bytes a second; a dash for times too short to tell."""
    rate = F.floor(F.try_divide(size.cast("double"), seconds)).cast("long")
    return F.when(seconds < 0.005, F.lit("—")).otherwise(F.concat(human_bytes(rate), F.lit("/s")))


def bar(share: Column, width: int) -> Column:
    """A share of 0 to 1 as a bar of eighths."""
    eighths = F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (width * 8) + 0.5).cast("int")
    part = F.substring(F.lit("▏▎▍▌▋▊▉"), F.greatest(eighths % 8, F.lit(1)), F.when(eighths % 8 > 0, 1).otherwise(0))
    return F.rpad(F.concat(F.array_join(F.array_repeat(F.lit("█"), (eighths / 8).cast("int")), ""), part), width, "·")


def camera_name(make: Column, model: Column) -> Column:
    """Make and model; the model alone where it begins with the make, in either case."""
    return F.when(F.lower(model).startswith(F.lower(make)), model).otherwise(F.concat_ws(" ", make, model))


def dynamic_range(bits: Column, sample_format: Column, raw: Column, profile: Column | None = None) -> Column:
    """What a colour profile, bit depth and sample format tell of a file's range; null where they tell nothing.

    profile: the struct of sources.icc. Its transfer curve, or else its description, comes first.
    """
    hdr = F.lit(None).cast("string")
    if profile is not None:
        coded = F.concat_ws(", ", F.lit("HDR"), profile["transfer"], profile["primaries"])
        hdr = F.when(profile["hdr"] & profile["transfer"].isNotNull(), coded).when(profile["hdr"], F.concat(F.lit("HDR, "), F.coalesce(profile["description"], F.lit("declared by ICC profile"))))
    return (
        F.when(hdr.isNotNull(), hdr)
        .when(sample_format == 3, F.lit("floating point, scene-linear, unbounded"))
        .when(raw & (bits >= 12), F.concat(F.lit("high, "), bits.cast("string"), F.lit("-bit linear sensor data")))
        .when(bits == 8, F.lit("standard, 8-bit, display-referred"))
    )


def orientation(value: Column) -> Column:
    """1 to 8, else 1."""
    return F.when(value.between(1, 8), value).otherwise(F.lit(1))
