"""String kernels: trimming, delimiters, charsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES, SNIFF_LEAST = 12, 3


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)\S")


def text_lines(c: Column) -> Column:
    """Lines without their line feed, and without the carriage return before it."""
    return F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))


def outside_quotes(line: Column) -> Column:
    """A line without its quoted parts; an open quote runs to the end of the line."""
    return F.regexp_replace(line, r'"[^"]*("|$)', "")


def count_of(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def sniff_delimited(text: Column) -> Column:
    """The delimiter of text that is delimited, else null: at least SNIFF_LEAST lines, all but one of
    which have as many delimiters as the first, which has some."""
    head = F.slice(F.filter(F.split(text, "\n"), lambda x: ~is_blank(x)), 1, SNIFF_LINES)
    bare = F.transform(head, lambda x: outside_quotes(F.regexp_replace(x, r"\r$", "")))
    return bound(F.when(text.isNotNull(), bare), _agreed)


def _counts(lines: Column, d: str) -> Column:
    return F.transform(lines, lambda x: count_of(x, d))


def _agreed(bare: Column) -> Column:
    found = F.lit(None).cast("string")
    for d in reversed(DELIMITERS):
        found = F.when(bound(_counts(bare, d), _agree), F.lit(d)).otherwise(found)
    return F.when(F.size(bare) >= SNIFF_LEAST, found)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _agree(counts: Column) -> Column:
    first = F.get(counts, F.lit(0))
    sames = F.size(counts) - F.size(F.array_remove(counts, first))
    return (first > 0) & (sames >= F.size(counts) - 1)


def parse_charset(content: Column) -> Column:
    """One character class a line, blank ones left out."""
    return F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"[\r\n]+$", "")), lambda x: x != "")
