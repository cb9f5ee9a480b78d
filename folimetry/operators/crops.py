"""Regions of page images: crops by box and polygon, and frames drawn around boxes, a page a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folimetry.operators import raster

CROP = "struct<width:int,height:int,pixels:binary>"


def _image(raw, width, channels: int) -> np.ndarray | None:
    if raw is None or pd.isna(width) or width < 1 or len(raw) % (int(width) * channels):
        return None
    return np.frombuffer(raw, np.uint8).reshape(-1, int(width), channels)


def crop_regions(pages: DataFrame, pixels: str, width: str, box: Column, polygon: Column | None = None, channels: int = 3, fill: int = raster.WHITE) -> DataFrame:
    """The columns of `pages` and `crop`, a struct of width, height and pixels: the part in `box` (array of four) with `fill`
    outside `polygon` (array of points), both in thousandths of the page's sides.

    Without a polygon of three points only the box counts. Pages whose bytes aren't whole rows, and null boxes or such with
    nulls, have a null crop; a null or empty page has one, too. Crops beyond the page are filled with 0.
    """

    @F.pandas_udf(CROP)
    def run(raws: pd.Series, widths: pd.Series, boxes: pd.Series, polygons: pd.Series) -> pd.DataFrame:
        out = []
        for raw, w, b, points in zip(raws, widths, boxes, polygons, strict=True):
            page = _image(raw, w, channels)
            if page is None or b is None or len(b) != 4 or any(pd.isna(v) for v in b):
                out.append((None, None, None))
                continue
            listed = None if points is None else [(float(p[0]), float(p[1])) for p in points if p is not None and len(p) >= 2]
            made = raster.cropped(page, tuple(map(float, b)), listed, fill)
            out.append((made.shape[1], made.shape[0], made.tobytes()))
        return pd.DataFrame(out, columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    points = F.lit(None).cast("array<array<double>>") if polygon is None else polygon
    made = run(F.col(pixels), F.col(width).cast("int"), box.cast("array<double>"), points)
    return pages.withColumn("crop", made).withColumn("crop", F.when(F.col("crop.pixels").isNotNull(), F.col("crop")))


def draw_boxes(pages: DataFrame, pixels: str, width: str, boxes: Column, colour: tuple[int, ...] = (255, 0, 0), thickness: int = 2) -> DataFrame:
    """The columns of `pages` with frames drawn into `pixels` around `boxes`, an array of struct<x1, y1, x2, y2> in pixels.
    Null boxes and those with a null side aren't drawn; pages whose bytes aren't whole rows stay as they are."""
    sides = F.transform(F.coalesce(boxes, F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")), lambda b: F.array(*(b[k].cast("double") for k in ("x1", "y1", "x2", "y2"))))

    @F.pandas_udf("binary")
    def run(raws: pd.Series, widths: pd.Series, lists: pd.Series) -> pd.Series:
        out = []
        for raw, w, listed in zip(raws, widths, lists, strict=True):
            page = _image(raw, w, len(colour))
            whole = [tuple(int(v) for v in b) for b in listed if b is not None and not any(pd.isna(v) for v in b)]
            out.append(raw if page is None else raster.outlined(page, whole, colour, thickness).tobytes())
        return pd.Series(out, dtype=object)

    return pages.withColumn(pixels, run(F.col(pixels), F.col(width).cast("int"), sides))


def limit_images(pages: DataFrame, pixels: str, width: str, long_side: int = 3500, channels: int = 3) -> DataFrame:
    """The columns of `pages` with `pixels` and `width` of images whose longer side is `long_side` at most: larger ones are
    resampled in proportion. Pages whose bytes aren't whole rows, and null ones, stay as they are."""

    @F.pandas_udf("struct<pixels:binary,width:int>")
    def run(raws: pd.Series, widths: pd.Series) -> pd.DataFrame:
        out = []
        for raw, w in zip(raws, widths, strict=True):
            page = _image(raw, w, channels)
            made = None if page is None else raster.limited(page, long_side)
            out.append((raw, None if pd.isna(w) else int(w)) if made is None else (made.tobytes(), made.shape[1]))
        return pd.DataFrame(out, columns=["pixels", "width"]).astype({"width": "Int32"})

    made = pages.withColumn("__made", run(F.col(pixels), F.col(width).cast("int")))
    return made.withColumns({pixels: F.col("__made.pixels"), width: F.col("__made.width")}).drop("__made")
