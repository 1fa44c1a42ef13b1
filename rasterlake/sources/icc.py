"""Colour profiles: header, description, and coding-independent code points.

Fixed values: the code points' names are those of ITU-T H.273.
"""

from __future__ import annotations

import struct

import pandas as pd

MAX_TAGS = 1024
PRIMARIES = {1: "BT.709 / sRGB", 5: "BT.601 625", 6: "BT.601 525", 7: "BT.601 525", 9: "BT.2020 / BT.2100", 11: "DCI-P3", 12: "Display P3"}
TRANSFER = {1: "BT.709", 4: "gamma 2.2", 5: "gamma 2.8", 6: "BT.709", 8: "linear", 13: "sRGB", 14: "BT.709", 15: "BT.709", 16: "PQ (SMPTE ST 2084)", 18: "HLG (ARIB STD-B67)"}
SCHEMA = "struct<version:string,device_class:string,description:string,primaries:string,transfer:string,hdr:boolean,curve:string,bt2020:boolean>"


def _text(raw: bytes) -> str | None:
    if raw[:4] == b"mluc" and len(raw) >= 28:
        size, at = struct.unpack(">II", raw[20:28])
        return raw[at : at + size].decode("utf-16-be", "replace").rstrip("\0") or None
    if raw[:4] == b"desc" and len(raw) >= 12:
        n = struct.unpack(">I", raw[8:12])[0]
        return raw[12 : 12 + n].split(b"\0")[0].decode("latin-1") or None
    return None


def parse(raw: bytes) -> dict:
    """version, device_class, description, primaries, transfer, hdr; ValueError if it is no profile."""
    if len(raw) < 132 or raw[36:40] != b"acsp":
        raise ValueError("not a colour profile")
    count = struct.unpack(">I", raw[128:132])[0]
    if count > MAX_TAGS:
        raise ValueError(f"profile of {count} tags")
    out = {"version": f"{raw[8]}.{raw[9] >> 4}", "device_class": raw[12:16].decode("latin-1").strip(), "description": None, "primaries": None, "transfer": None, "hdr": False, "curve": "srgb", "bt2020": False}
    for i in range(count):
        head = raw[132 + 12 * i : 144 + 12 * i]
        if len(head) < 12:
            break
        name, at, size = head[:4], *struct.unpack(">II", head[4:])
        body = raw[at : at + size]
        if len(body) < size:
            continue
        if name == b"desc":
            out["description"] = _text(body)
        elif name == b"cicp" and size >= 12:
            p, t = body[8], body[9]
            out |= {"primaries": PRIMARIES.get(p, "unknown primaries"), "transfer": TRANSFER.get(t, "unknown transfer"), "hdr": t in (16, 18), "curve": {16: "pq", 18: "hlg"}.get(t, "srgb"), "bt2020": p == 9}
    if out["transfer"] is None and out["description"]:
        # A profile without code points may be told by its name: fixed values, names of standards.
        name = out["description"].lower()
        out["hdr"] = any(x in name for x in ("2100", "2084", "hlg", " pq")) or name.endswith("pq")
    return out


def profile(raw):
    """A column of profiles' bytes as a column of SCHEMA; null where there is no profile."""
    from pyspark.sql import functions as F

    @F.pandas_udf(SCHEMA)
    def of(col: pd.Series) -> pd.DataFrame:
        def one(x):
            try:
                return parse(bytes(x)) if x is not None else {}
            except ValueError:
                return {}

        names = [f.split(":")[0] for f in SCHEMA[7:-1].split(",")]
        return pd.DataFrame([{n: r.get(n) for n in names} for r in map(one, col)], columns=names, index=col.index)

    return of(raw)
