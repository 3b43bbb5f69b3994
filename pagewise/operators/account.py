"""Accounting: pages to documents. Every page is text, ocr or unresolved, and none is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, trimmed


def join_pages(markers: bool = False) -> Column:
    """Aggregate of (number, markdown): pages that aren't blank, in order, a blank line between."""
    body = trimmed(F.col("markdown"))
    if markers:
        body = F.concat(F.lit("<!-- Page "), F.col("number").cast("string"), F.lit(" -->\n\n"), body)
    rows = F.array_sort(F.collect_list(F.when(~is_blank(F.col("markdown")), F.struct("number", body.alias("body")))))
    return F.array_join(F.transform(rows, lambda r: r["body"]), "\n\n")


def pages_of(origin: str) -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("origin") == origin, F.col("number"))))


def receipt(pages: Column, text: Column, ocr: Column, unresolved: Column, marked: Column) -> Column:
    """What was read of a document, without the time it took."""
    s = lambda c: c.cast("string")
    return F.concat(s(pages), F.lit(" page(s): "), s(text), F.lit(" extracted, "), s(ocr), F.lit(" recognised, "), s(unresolved), F.lit(" unresolved, "), s(marked), F.lit(" marked for a person"))


def roll_up(pages: DataFrame, key: str = "file_id", *, markers: bool = False, strict: bool = False) -> DataFrame:
    """pages (key, number, markdown, origin, human_regions) to documents, one row each; with strict,
    a document with unresolved pages carries the error ocr_required."""
    n = lambda o: F.count_if(F.col("origin") == o)
    out = pages.groupBy(key).agg(
        join_pages(markers).alias("markdown"), F.count("*").alias("page_count"), n("text").alias("extracted"), n("ocr").alias("recognised"), n("unresolved").alias("unresolved"),
        F.sum("human_regions").alias("marked"), pages_of("ocr").alias("ocr_pages"), pages_of("unresolved").alias("unresolved_pages"),
        F.array_sort(F.collect_list(F.when(F.col("human_regions") > 0, F.col("number")))).alias("human_pages"),
    )
    missing = F.size("unresolved_pages") > 0
    error = F.when(F.lit(strict) & missing, F.struct(F.lit("ocr_required").alias("kind"), F.size("unresolved_pages").cast("long").alias("pages")))
    return out.withColumns({"complete": ~missing, "needs_a_person": F.size("human_pages") > 0, "receipt": receipt(F.col("page_count"), F.col("extracted"), F.col("recognised"), F.col("unresolved"), F.col("marked")), "error": error})
