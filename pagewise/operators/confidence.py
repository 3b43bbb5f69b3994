"""Confidence of lines and pages, and what a person should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import PAGE

#: Measured floors of handwriting: variation of the stroke's width, and drift from the baseline.
VARIATION, DRIFT = 0.80, 0.08


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile of a sorted array: the element at round(q (n - 1))."""
    return F.get(values, F.round(F.lit(q) * (F.size(values) - 1)).cast("int"))


def page_confidence(boxes: DataFrame, *, review_below: float) -> DataFrame:
    """Mean and least confidence over a page's boxes (NaN stepped over), read mass, the reference
    median of boxes with text, and whether the page needs review."""
    c = F.col("confidence")
    finite = F.sort_array(F.collect_list(F.when(~F.isnan(c) & (F.length(F.trim("text")) > 0), c)))
    mean = F.coalesce(F.avg(c), F.lit(0.0))
    return boxes.groupBy(*PAGE).agg(mean.alias("confidence"), F.coalesce(F.nanvl(F.min(c), F.lit(0.0)), F.lit(0.0)).alias("min_confidence"), F.sum(c * F.length("text")).alias("read_mass"), F.coalesce(nearest_rank(finite, 0.5), F.lit(0.0)).alias("reference"), (mean < review_below).alias("needs_review"))


def weak_boxes(placed: DataFrame, floor: float) -> DataFrame:
    return placed.filter(F.col("confidence") < floor)


def weakest_first(lines: DataFrame, k: int) -> DataFrame:
    """The k lines to look at first."""
    return lines.orderBy("min_confidence", *PAGE, "line_no").limit(k)


def is_handwriting(variation: Column, drift: Column, floors: tuple[float, float] = (VARIATION, DRIFT)) -> Column:
    return F.coalesce((variation >= floors[0]) & (drift >= floors[1]), F.lit(False))
