"""Rasters of pages: size guards, painting of regions, the proof that they are black, and preparation for recognition.

A raster is a row: keys, page_index, width, height (pixels), scale (pixels a point), pixels (RGBA, row by row). Whoever renders
provides them. A raster is handled by itself in Arrow batches; regions meet it by page.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import RECT
from .mask import grayscale, is_black, opaque_rgb, padded_rect, paint, sharpen, stretch

#: Most pixels of a side and of a page.
SIDE, PIXELS = 65_535, 100_000_000


def size_error(width: Column, height: Column, scale: Column) -> Column:
    """Why a page can't be rendered at a scale: "scale", "page", "side", "pixels"; null where it can."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")) & (c > 0), F.lit(False))
    s = scale.cast("double")
    return (
        F.when(~finite(s), "scale").when(~(finite(width) & finite(height)), "page")
        .when(s > SIDE / F.greatest(width, height), "side").when(width.cast("double") * height * s * s > PIXELS, "pixels")
    )


def to_points(rect: Column, scale: Column) -> Column:
    """A rectangle of pixels in points."""
    return F.struct(*((rect[c] / scale).cast("float").alias(c) for c in "xywh"))


def _rects(regions: DataFrame, keys: tuple[str, ...], pad: float | None) -> DataFrame:
    """The rectangles of the included regions of each page, padded for painting."""
    each = regions.where(F.col("included")).select(*keys, "page_index", F.explode("rects").alias("r"))
    if pad is not None:
        x, y, w, h = padded_rect(*(F.col(f"r.{c}").cast("double") for c in "xywh"), pad)
        each = each.select(*keys, "page_index", F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")).cast(RECT).alias("r"))
    return each.groupBy(*keys, "page_index").agg(F.sort_array(F.collect_list("r")).alias("rects_"))


def _image(width: int, height: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, dtype=np.uint8).reshape(height, width, 4)


def _plain(rects) -> list[tuple]:
    return [] if rects is None else [(r["x"], r["y"], r["w"], r["h"]) for r in rects]


def painted(rasters: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), pad: float = 1.5) -> DataFrame:
    """rasters with the included regions in black. An image that isn't opaque, and a region that isn't black afterwards, are errors."""

    @F.pandas_udf("binary")
    def run(width: pd.Series, height: pd.Series, scale: pd.Series, pixels: pd.Series, padded: pd.Series, plain: pd.Series) -> pd.Series:
        out = []
        for w, h, s, p, wide, rects in zip(width, height, scale, pixels, padded, plain, strict=True):
            image = _image(w, h, p)
            opaque_rgb(image)
            done = paint(image, _plain(wide), s)
            if not all(is_black(done, r, s) for r in _plain(rects)):
                raise ValueError("a region isn't black")
            out.append(done.tobytes())
        return pd.Series(out)

    both = rasters.join(_rects(regions, keys, pad).withColumnRenamed("rects_", "padded_"), [*keys, "page_index"], "left").join(_rects(regions, keys, None), [*keys, "page_index"], "left")
    return both.withColumn("pixels", run("width", "height", "scale", "pixels", "padded_", "rects_")).select(*rasters.columns)


def pixel_removal(rasters: DataFrame, regions: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys and the check that the inside of each included region is black on its page; regions without a raster fail."""

    @F.pandas_udf("int")
    def left(width: pd.Series, height: pd.Series, scale: pd.Series, pixels: pd.Series, rects: pd.Series) -> pd.Series:
        def count(w, h, s, p, r) -> int:
            if p is None:
                return len(r)
            image, bad = _image(int(w), int(h), p), 0
            for x in _plain(r):
                try:
                    bad += not is_black(image, x, s)
                except ValueError:  # no valid rectangle, or off the page
                    bad += 1
            return bad

        return pd.Series([count(*row) for row in zip(width, height, scale, pixels, rects, strict=True)])

    pages = _rects(regions, keys, None).join(rasters, [*keys, "page_index"], "left")
    counted = pages.select(*keys, "page_index", F.size("rects_").alias("n_"), left("width", "height", "scale", "pixels", "rects_").alias("left_"))
    done = counted.groupBy(*keys).agg(F.sum("n_").alias("n_"), F.sum("left_").alias("left_"))
    check = F.struct(F.lit("pixel-removal").alias("id"), (F.coalesce("left_", F.lit(0)) == 0).alias("passed"), F.concat(F.coalesce("left_", F.lit(0)).cast("string"), F.lit(" of "), F.coalesce("n_", F.lit(0)).cast("string"), F.lit(" not black")).alias("detail"))
    return rasters.select(*keys).distinct().join(done, list(keys), "full").select(*keys, check.alias("check"))


def prepared(rasters: DataFrame, mode: str = "light") -> DataFrame:
    """rasters as recognisers like them: off unchanged; light in gray and stretched; strong also sharpened and stretched again."""
    if mode not in ("off", "light", "strong"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "off":
        return rasters

    @F.pandas_udf("binary")
    def run(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.Series:
        out = []
        for w, h, p in zip(width, height, pixels, strict=True):
            gray = grayscale(_image(w, h, p))
            gray = stretch(gray, 2, 98) if mode == "light" else stretch(sharpen(stretch(gray, 1, 99)), 2, 98)
            out.append(np.dstack([gray, gray, gray, np.full_like(gray, 255)]).tobytes())
        return pd.Series(out)

    return rasters.withColumn("pixels", run("width", "height", "pixels"))
