"""Measures of picture columns (pixels array<int>, width, height) and of detector outputs, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions import boxes, pictures

def _shaped(pixels, width, height, planes: int = 1) -> np.ndarray:
    shape = (int(height), int(width)) if planes == 1 else (int(height), int(width), planes)
    return np.asarray(pixels, np.int64).reshape(shape)


def _each(make, *columns: pd.Series) -> list:
    return [None if any(x is None for x in row) else make(*row) for row in zip(*columns)]


def measures(pixels: Column, width: Column, height: Column) -> Column:
    """struct<brightness, sharpness, bits> of a gray picture; bits are the 64 signs of its difference hash as text."""

    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        made = _each(lambda *x: _shaped(*x), p, w, h)
        of = lambda f: [None if g is None else f(g) for g in made]
        return pd.DataFrame({"brightness": of(pictures.brightness), "sharpness": of(pictures.laplacian_variance), "bits": of(lambda g: format(pictures.dhash(g), "064b"))})

    return F.pandas_udf(run, "brightness double, sharpness double, bits string")(pixels, width, height)


def changes(before: Column, after: Column) -> Column:
    """struct<diff, change> of two gray pictures of one size; null without the one before."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        made = _each(lambda x, y: (pictures.mean_abs_diff(np.asarray(x), np.asarray(y)), pictures.hist_change(np.asarray(x), np.asarray(y))), a, b)
        return pd.DataFrame({"diff": [m and m[0] for m in made], "change": [m and m[1] for m in made]}).astype(float)

    both = F.pandas_udf(run, "diff double, change double")(before, after)
    return F.when(before.isNotNull() & after.isNotNull(), both)


def gray(rgb: Column, width: Column, height: Column, side: int = pictures.SIDE) -> Column:
    """struct<pixels, width, height> of a colour picture (three values a pixel), shrunk."""

    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        made = _each(lambda *x: pictures.small_gray(_shaped(*x, 3), side), p, w, h)
        return pd.DataFrame({"pixels": [m.ravel().tolist() for m in made], "width": [m.shape[1] for m in made], "height": [m.shape[0] for m in made]})

    return F.pandas_udf(run, "pixels array<int>, width int, height int")(rgb, width, height)


def letterboxed(rgb: Column, width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """struct<pixels, scale> of a colour picture fitted into to_width x to_height."""

    def run(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.DataFrame:
        made = _each(lambda *x: pictures.letterbox(_shaped(*x, 3), to_width, to_height), p, w, h)
        return pd.DataFrame({"pixels": [m[0].ravel().tolist() for m in made], "scale": [m[1] for m in made]})

    return F.pandas_udf(run, "pixels array<int>, scale double")(rgb, width, height)


def mono(samples: Column, channels: int, rate: int, target: int = 16_000) -> Column:
    """array<int>: interleaved samples of 16 bits as one channel at `target` a second; no samples (no track) give silence: none."""

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else pictures.Resampler(rate, channels, target).feed(np.asarray(x)).tolist() for x in s], dtype=object)

    return F.pandas_udf(run, "array<int>")(samples)


def _decoded(df: DataFrame, key: str, rows: str, make) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [(k, c, p, list(map(float, b))) for k, r in zip(pdf[key], pdf[rows]) if r is not None and len(r) for c, p, b in make(np.stack(r))]
            yield pd.DataFrame(found, columns=[key, "cls", "conf", "box"])

    return df.select(key, rows).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, cls int, conf double, box array<double>")


def grid_boxes(df: DataFrame, key: str, rows: str, width: int, height: int, ratio: float, least: float) -> DataFrame:
    """key, cls, conf, box of a grid detector's rows (x, y, w, h, objectness, classes..); null or empty rows give none."""
    return _decoded(df, key, rows, lambda r: boxes.decode_grid(r, width, height, ratio, least))


def query_boxes(df: DataFrame, key: str, rows: str, width: int, height: int, least: float = 0.5) -> DataFrame:
    """The same of a query detector's rows (cx, cy, w, h in shares, logits..)."""
    return _decoded(df, key, rows, lambda r: boxes.decode_queries(r[:, 4:], r[:, :4], width, height, least))


def word_boxes(df: DataFrame, key: str, rows: str, scale: float, width: int, height: int, least: float) -> DataFrame:
    """The same of a word detector's rows: cx, cy, w, h, then a row of scores for each word."""
    return _decoded(df, key, rows, lambda r: boxes.decode_columns(r, scale, width, height, least))
