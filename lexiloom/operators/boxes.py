"""Arithmetic of line boxes and crops; boxes are arrays of struct<x,y,w,h>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import merge_neighbours, merge_overlapping, upper_median


def keep_large(boxes: Column, height: int = 8, width: int = 20) -> Column:
    return F.filter(boxes, lambda b: (b["h"] >= height) & (b["w"] >= width))


def keep_relative(boxes: Column, share: float = 0.35, aspect: float = 80.0) -> Column:
    """Without boxes far lower than the median one (3 at least) or far wider than high."""
    least = F.greatest(F.lit(3), F.floor(upper_median(F.transform(boxes, lambda b: b["h"])) * share))
    return F.filter(boxes, lambda b: (b["h"] >= least) & (b["w"] / F.greatest(F.lit(1), b["h"]) <= aspect))


def reading_order(boxes: Column) -> Column:
    return F.transform(F.array_sort(F.transform(boxes, lambda b: F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h")))), lambda b: F.struct(*(b[k].alias(k) for k in "xywh")))


def crop_bounds(b: Column, page_w: Column, page_h: Column, pad_x: int = 10, pad_y: int = 5, least: int = 14) -> Column:
    """struct<y0,y1,x0,x1>: a box grown to the least height about its middle, padded, within the page."""
    tall = F.greatest(b["h"], F.lit(least))
    half = lambda c: F.floor(c / 2).cast("int")
    bottom = F.least(page_h, F.greatest(F.lit(0), b["y"] + half(b["h"]) - half(tall)) + tall)
    top = F.greatest(F.lit(0), bottom - tall)
    return F.struct(F.greatest(F.lit(0), top - pad_y).alias("y0"), F.least(page_h, bottom + pad_y).alias("y1"), F.greatest(F.lit(0), b["x"] - pad_x).alias("x0"), F.least(page_w, b["x"] + b["w"] + pad_x).alias("x1"))


def manual_box(band: Column, page_w: Column, page_h: Column) -> Column:
    """A configured band (y0, y1, optional x0, x1), kept within the page; one pixel at least."""
    y0, y1 = F.greatest(F.lit(0), band["y0"]), F.least(page_h, band["y1"])
    x0, x1 = F.greatest(F.lit(0), F.coalesce(band["x0"], F.lit(0))), F.least(page_w, F.coalesce(band["x1"], page_w))
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(1), x1 - x0).alias("w"), F.greatest(F.lit(1), y1 - y0).alias("h"))


def resized_width(w: Column, h: Column, height: int, longest: int, least: int = 0) -> Column:
    """Width at a fixed height; halves round to even; a least width is reached by padding."""
    new = F.greatest(F.lit(1), F.bround(w * height / F.greatest(F.lit(1), h), 0)).cast("int")
    return F.greatest(F.least(new, F.lit(longest)), F.lit(least))


def padded(rows: Column, value: float = 1.0) -> Column:
    """Arrays of an array, each filled up on the right to the longest."""
    longest = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(value), longest - F.size(r))))


def inverted(pixels: Column, threshold: float = 128.0) -> Column:
    """Whether an image is dark on the whole."""
    return F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / F.size(pixels) < threshold


def refined(found: Column, height: int = 8, width: int = 20, neighbours: bool = True, overlapping: bool = True) -> Column:
    """Boxes of a page without small ones, those of one row or band joined, in reading order."""
    out = keep_large(found, height, width)
    out = merge_neighbours(out) if neighbours else out
    return reading_order(merge_overlapping(out) if overlapping else out)
