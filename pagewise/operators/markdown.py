"""Markdown of a page's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, is_blank, trimmed
from .layout import PAGE, by_page

GAP, LEVELS = 1.8, ((1.6, 1), (1.3, 2), (1.15, 3))
LOW = " <!-- low confidence -->"


def heading_level(height: Column, body: Column) -> Column:
    ratio = F.when(body > 0, height / body)
    out = F.lit(None).cast("int")
    for least, level in reversed(LEVELS):
        out = F.when(ratio >= least, level).otherwise(out)
    return out


def _upper_median(heights: Column) -> Column:
    hs = F.sort_array(heights)
    return F.coalesce(F.get(hs, F.floor(F.size(hs) / 2).cast("int")), F.lit(0.0))


def _body(lines: Column) -> Column:
    return _upper_median(F.filter(F.transform(lines, lambda s: s["height"]), lambda h: h > 0))


def body_heights(lines: DataFrame) -> DataFrame:
    """The upper median of the heights of a page's lines."""
    return by_page(lines).select(*PAGE, _body(F.col("lines")).alias("body"))


def heading_levels(lines: DataFrame) -> DataFrame:
    """(file_id, page, line_no, level) of the lines that are headings."""
    level = lambda body: F.transform("lines", lambda s: F.struct(s["line_no"].alias("line_no"), heading_level(s["height"], body).alias("level")))
    return by_page(lines).select(*PAGE, F.inline(bound(_body(F.col("lines")), level))).filter("level is not null")


def to_markdown(lines: DataFrame, *, confidence_floor: float = 0.5, mark_uncertain: bool = True) -> DataFrame:
    """(file_id, page, markdown)."""

    def piece(s: Column, before: Column, body: Column) -> Column:
        def of(level: Column) -> Column:
            mark = F.when(F.lit(mark_uncertain) & (s["min_confidence"] < confidence_floor), LOW).otherwise("")
            gap = (body > 0) & (s["baseline_y"] - before > GAP * body)
            lead = F.when(before.isNull(), "").otherwise(F.concat(F.lit("\n"), F.when(gap, "\n").otherwise(""), F.when(level.isNotNull(), "\n").otherwise("")))
            head = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), s["text"], mark, F.lit("\n"))
            return F.concat(lead, F.when(level.isNotNull(), head).otherwise(F.concat(s["text"], mark)))

        return bound(heading_level(s["height"], body), of)

    def text(body: Column) -> Column:
        pieces = F.transform("_kept", lambda s, k: piece(s, F.get(F.col("_kept"), k - 1)["baseline_y"], body))
        return F.concat(trimmed(F.array_join(pieces, "")), F.lit("\n"))

    kept = by_page(lines).select(*PAGE, "lines", F.filter("lines", lambda s: ~is_blank(s["text"])).alias("_kept")).filter(F.size("_kept") > 0)
    return kept.select(*PAGE, bound(_body(F.col("lines")), text).alias("markdown"))
