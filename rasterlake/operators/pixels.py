"""Pixel operations on columns of arrays in row order: images of any size, by the kernels for whole images.

Sides may be columns or numbers. A null array, or one that does not fit its sides, gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images


def _side(x: Column | int) -> Column:
    return F.lit(x).cast("int") if isinstance(x, int) else x.cast("int")


def _each(work: Callable, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if row[0] is None else work(*row) for row in zip(*columns, strict=True)], dtype=object)


def _grid(pixels, w: int, h: int) -> np.ndarray | None:
    a = np.asarray(pixels)
    return a.reshape(h, w) if len(a) == w * h else None


def _split(pixels, w, h):
    a = _grid(pixels, w, h)
    return None if a is None else [p.reshape(-1) for p in images.split_mosaic(a)]


def _merge(planes, w, h):
    parts = [_grid(p, w // 2, h // 2) for p in planes]
    return None if len(parts) != 4 or any(p is None for p in parts) else images.merge_mosaic(parts).reshape(-1)


def _average(pixels, w, h, ow, oh):
    a = _grid(pixels, w, h)
    return None if a is None else images.area_means(a.astype(float), ow, oh).reshape(-1)


def _turned(pixels, w, h, orientation):
    a = _grid(pixels, w, h)
    return None if a is None else np.ascontiguousarray(images.upright(a, orientation)).reshape(-1)


_PIXELS = T.ArrayType(T.LongType())


@F.pandas_udf(T.ArrayType(_PIXELS))
def _split_all(px: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return _each(_split, px, w, h)


@F.pandas_udf(_PIXELS)
def _merge_all(planes: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
    return _each(_merge, planes, w, h)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _average_all(px: pd.Series, w: pd.Series, h: pd.Series, ow: pd.Series, oh: pd.Series) -> pd.Series:
    return _each(_average, px, w, h, ow, oh)


@F.pandas_udf(_PIXELS)
def _turned_all(px: pd.Series, w: pd.Series, h: pd.Series, turn: pd.Series) -> pd.Series:
    return _each(_turned, px, w, h, turn)


def cfa_split(pixels: Column, w: Column | int, h: Column | int) -> Column:
    """Four planes of half the sides: even and odd columns of even rows, then of odd rows; sides must be even."""
    if isinstance(w, int) and isinstance(h, int) and (w % 2 or h % 2):
        raise ValueError(f"{w} x {h} has no whole 2 x 2 cells")
    return _split_all(pixels, _side(w), _side(h))


def cfa_merge(planes: Column, w: Column | int, h: Column | int) -> Column:
    """The mosaic of four planes."""
    return _merge_all(planes, _side(w), _side(h))


def area_average(pixels: Column, w: Column | int, h: Column | int, ow: Column | int, oh: Column | int) -> Column:
    """Means over the source pixels that each target pixel touches; neighbours may share pixels."""
    return _average_all(pixels, _side(w), _side(h), _side(ow), _side(oh))


def oriented(pixels: Column, w: Column | int, h: Column | int, orientation: Column | int) -> Column:
    """Upright pixels of an image stored with an orientation of 1 to 8."""
    return _turned_all(pixels, _side(w), _side(h), _side(orientation))
