"""Ceilings a read keeps to, and what is said when one is passed."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type of ceilings in tables: an unsigned 64-bit number doesn't fit a long.
CEILING = "decimal(20,0)"


@dataclass(frozen=True)
class Limits:
    """None means no ceiling. wall_clock_ms and resident_bytes are enforced outside the engine."""

    input_bytes: int | None = 50 * 1024 * 1024
    pages: int | None = 200
    pixels_per_page: int | None = 40_000_000
    wall_clock_ms: int | None = 60_000
    resident_bytes: int | None = 1 << 30
    archive_bytes: int | None = 200 * 1024 * 1024
    archive_entries: int | None = 10_000
    archive_depth: int | None = 2

    @classmethod
    def none(cls) -> Limits:
        return cls(**{f.name: None for f in fields(cls)})

    @classmethod
    def parse(cls, **given) -> Limits:
        """From keyword options, refusing unknown names and values that aren't ceilings."""
        allowed = [f.name for f in fields(cls)]
        for name, value in given.items():
            if name not in allowed:
                raise ValueError(f"unknown limit {name!r}; known: {', '.join(allowed)}")
            if value is not None and (isinstance(value, bool) or not isinstance(value, int | float) or value != value or value in (float("inf"),) or value < 0):
                raise ValueError(f"limit {name!r} must be a finite number of at least 0")
        return cls(**{k: None if v is None else int(v) for k, v in given.items()})


def exceeded(limit: str, allowed: int | None, found: Column | None, past: Column) -> Column:
    """A struct (limit, allowed, found) where `past` holds, else null. found null: not known, as counting stopped."""
    value = F.lit(None) if found is None else found
    said = F.struct(F.lit(limit).alias("limit"), F.lit(allowed).cast(CEILING).alias("allowed"), value.cast(CEILING).alias("found"))
    return F.when(past, said) if allowed is not None else F.lit(None).cast(f"struct<limit:string,allowed:{CEILING},found:{CEILING}>")


def message(limit: Column, allowed: Column, found: Column) -> Column:
    is_ = F.when(found.isNull(), F.concat(limit, F.lit(" is over the limit of "), allowed.cast("string")))
    return is_.otherwise(F.concat(limit, F.lit(" is "), found.cast("string"), F.lit(", over the limit of "), allowed.cast("string")))


def pixels_within(width: Column, height: Column, channels: Column, ceiling: int | None) -> Column:
    """Whether a raster is allowed: the product is taken without wrapping."""
    product = F.try_multiply(F.try_multiply(width.cast("decimal(20,0)"), height.cast("decimal(20,0)")).cast("decimal(38,0)"), channels.cast("decimal(10,0)"))
    big = F.coalesce(product <= F.lit(str(2**64 - 1)).cast("decimal(38,0)"), F.lit(False))
    return big if ceiling is None else big & (product <= F.lit(ceiling))
