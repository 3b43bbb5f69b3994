"""Geometry of pages and boxes, and the plan for a page, as column expressions in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS_PER_INCH, MAX_SIDE_PX, DEFAULT_DPI = 72.0, 4000.0, 150.0
MIN_TEXT_ITEMS, FULL_PAGE_IMAGE, BLANK_IMAGE = 8, 0.5, 0.01


def bbox(quad: Column) -> Column:
    """(x, y, w, h) of an array of points."""
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x).alias("w"), (F.array_max(ys) - y).alias("h"))


def center_y(y: Column, h: Column) -> Column:
    return y + h / 2


def page_scale(width_px, height_px, width_pt, height_pt) -> tuple[Column, Column]:
    """Pixels a point along each axis: of the picture and the page as they are, whatever resolution was asked for."""
    return width_px / width_pt, height_px / height_pt


def pixels_to_points(x, y, w, h, width_px, height_px, width_pt, height_pt) -> Column:
    """A pixel rectangle (origin top left) in points (origin bottom left)."""
    sx, sy = page_scale(width_px, height_px, width_pt, height_pt)
    return F.struct((x / sx).alias("x"), (height_pt - y / sy - h / sy).alias("y"), (w / sx).alias("w"), (h / sy).alias("h"))


def points_to_pixels(x, y, w, h, width_px, height_px, width_pt, height_pt) -> Column:
    sx, sy = page_scale(width_px, height_px, width_pt, height_pt)
    return F.struct((x * sx).alias("x"), ((height_pt - y - h) * sy).alias("y"), (w * sx).alias("w"), (h * sy).alias("h"))


def cap_dpi(width_pt: Column, height_pt: Column, requested: Column) -> Column:
    """(dpi, capped): the resolution at which no side passes MAX_SIDE_PX."""
    longest = F.greatest(width_pt, height_pt)
    most = F.when(longest > 0, F.lit(MAX_SIDE_PX * POINTS_PER_INCH) / longest)
    over = F.coalesce(requested > most, F.lit(False))
    return F.struct(F.when(over, most).otherwise(requested).alias("dpi"), over.alias("capped"))


def page_plan(items: Column, image_coverage: Column) -> Column:
    """What to do with a page of this many text items, a part of which is covered by images."""
    enough, image = items >= MIN_TEXT_ITEMS, image_coverage >= FULL_PAGE_IMAGE
    blank = (items == 0) & (image_coverage <= BLANK_IMAGE)
    return F.when(enough & ~image, "use_text_layer").when(enough, "use_text_layer_over_image").when(image, "rasterise").when(blank, "blank").otherwise("rasterise")


def to_original(x, y, orientation, skew, width, height, turned_w, turned_h) -> Column:
    """A point of the corrected image in the original one: skew is undone about the turned centre, then the quarter turn."""
    cx, cy, a = turned_w / 2, turned_h / 2, F.radians(skew)
    dx, dy = x - cx, y - cy
    flat = F.abs(skew) < 0.01
    u = F.when(flat, x).otherwise(cx + dx * F.cos(a) - dy * F.sin(a))
    v = F.when(flat, y).otherwise(cy + dx * F.sin(a) + dy * F.cos(a))
    px = F.when(orientation == 90, v).when(orientation == 180, width - 1 - u).when(orientation == 270, width - 1 - v).otherwise(u)
    py = F.when(orientation == 90, height - 1 - u).when(orientation == 180, height - 1 - v).when(orientation == 270, u).otherwise(v)
    return F.struct(px.alias("x"), py.alias("y"))


def to_frame(original: Column, crop_x: Column, crop_y: Column) -> Column:
    """A point of the cropped image, as to_original gives it, in the whole one."""
    return F.struct((original["x"] + crop_x).alias("x"), (original["y"] + crop_y).alias("y"))


def is_identity(orientation: Column, skew: Column) -> Column:
    """Whether a correction leaves points where they are, but for the crop."""
    return (orientation == 0) & (F.abs(skew) < 0.01)


def quarter_turn(x: Column, y: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Where a pixel goes when the image is turned clockwise."""
    px = F.when(degrees == 90, height - 1 - y).when(degrees == 180, width - 1 - x).when(degrees == 270, y).otherwise(x)
    py = F.when(degrees == 90, x).when(degrees == 180, height - 1 - y).when(degrees == 270, width - 1 - x).otherwise(y)
    return F.struct(px.alias("x"), py.alias("y"))
