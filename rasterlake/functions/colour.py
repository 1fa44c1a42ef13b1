"""Transfer curves and tone mapping as column expressions, and as numpy for whole images.

Fixed values: the constants of sRGB, of perceptual quantisation (SMPTE ST 2084), of hybrid log-gamma
(ARIB STD-B67) and of the BT.2020 primaries, the white of 203 nits and the knee of the tone curve.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_NITS = 203.0
PQ = {"m1": 0.15930176, "m2": 78.84375, "c1": 0.8359375, "c2": 18.851562, "c3": 18.6875}
HLG = {"a": 0.17883277, "b": 0.28466892, "c": 0.5599107, "white": 0.2649006}
LUMINANCE = (0.2627, 0.6780, 0.0593)
BT2020_TO_SRGB = ((1.660491, -0.587641, -0.07285), (-0.12455, 1.1329, -0.008349), (-0.018151, -0.100579, 1.11873))
KNEE = 0.8


def clamp(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    c = clamp(c)
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def pq_to_linear(e: Column) -> Column:
    p = F.pow(clamp(e), F.lit(1 / PQ["m2"]))
    below = PQ["c2"] - PQ["c3"] * p
    return F.when(below <= 0, F.lit(0.0)).otherwise(F.pow(F.greatest(p - PQ["c1"], F.lit(0.0)) / below, F.lit(1 / PQ["m1"])) * (10_000 / WHITE_NITS))


def hlg_to_linear(e: Column) -> Column:
    e = clamp(e)
    return F.when(e <= 0.5, e * e / 3).otherwise((F.exp((e - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12) / HLG["white"]


def tone_gain(luminance: Column) -> Column:
    """What a pixel's channels are multiplied by, from its luminance."""
    mapped = KNEE + (1 - KNEE) * (1 - F.exp(-(luminance - KNEE) / (1 - KNEE)))
    return F.when(luminance <= KNEE, F.lit(1.0)).otherwise(mapped / luminance)


def curve(transfer: str, e: np.ndarray) -> np.ndarray:
    """Encoded values of 0 to 1 as linear light."""
    e = np.clip(e, 0, 1)
    if transfer == "pq":
        p = e ** (1 / PQ["m2"])
        below = PQ["c2"] - PQ["c3"] * p
        return np.where(below <= 0, 0.0, (np.maximum(p - PQ["c1"], 0) / np.where(below <= 0, 1, below)) ** (1 / PQ["m1"])) * (10_000 / WHITE_NITS)
    if transfer == "hlg":
        return np.where(e <= 0.5, e * e / 3, (np.exp((e - HLG["c"]) / HLG["a"]) + HLG["b"]) / 12) / HLG["white"]
    return np.where(e <= 0.04045, e / 12.92, ((e + 0.055) / 1.055) ** 2.4)


def encoded(linear: np.ndarray) -> np.ndarray:
    """Linear light as sRGB bytes."""
    c = np.clip(linear, 0, 1)
    return (np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(np.uint8)


def finished(linear: np.ndarray, hdr: bool, bt2020: bool) -> np.ndarray:
    """Linear (..., 3) light as sRGB bytes; bright HDR is bent under 1 by luminance, which keeps hues."""
    if hdr:
        y = linear @ np.array(LUMINANCE)
        mapped = KNEE + (1 - KNEE) * (1 - np.exp(-(y - KNEE) / (1 - KNEE)))
        linear = linear * np.where(y > KNEE, mapped / np.where(y > KNEE, y, 1), 1)[..., None]
    if bt2020:
        linear = linear @ np.array(BT2020_TO_SRGB).T
    return encoded(linear)
