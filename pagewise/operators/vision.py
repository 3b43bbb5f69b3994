"""Relational forms of the page-image measures, over pixels (image_id, x, y, level) as rows.

The same measures over whole rasters, in numpy, are in sources/raster.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .confidence import nearest_rank

SIDEWAYS = 1.3


def otsu_levels(pixels: DataFrame) -> DataFrame:
    """(image_id, level): the level that maximises the variance between classes, the first of equals;
    0 for a single tone."""
    hist = pixels.groupBy("image_id", "level").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("image_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("image_id")
    h = hist.withColumns({"wb": F.sum("n").over(upto).cast("double"), "sb": F.sum(F.col("n") * F.col("level")).over(upto).cast("double"), "w": F.sum("n").over(whole).cast("double"), "s": F.sum(F.col("n") * F.col("level")).over(whole).cast("double")})
    wf = F.col("w") - F.col("wb")
    d = F.col("sb") / F.col("wb") - (F.col("s") - F.col("sb")) / F.when(wf > 0, wf)
    h = h.withColumn("v", F.coalesce(F.col("wb") * wf * d * d, F.lit(0.0)))
    best = h.groupBy("image_id").agg(F.max(F.struct("v", (-F.col("level")).alias("k"))).alias("b"))
    return best.select("image_id", F.when(F.col("b.v") > 0, -F.col("b.k")).otherwise(0).cast("int").alias("level"))


def ink_mask(pixels: DataFrame) -> DataFrame:
    """pixels with ink: dark ones, or light ones if dark ones are the majority."""
    p = pixels.join(otsu_levels(pixels).withColumnRenamed("level", "otsu"), "image_id")
    dark = F.col("level") <= F.col("otsu")
    many = F.sum(F.when(dark, 1).otherwise(0)).over(Window.partitionBy("image_id")) * 2 > F.count("*").over(Window.partitionBy("image_id"))
    return p.withColumn("ink", dark != many).drop("otsu")


def orient_evidence(ink: DataFrame) -> DataFrame:
    """Variance over mean squared of the ink by row and by column, and the verdict."""

    def axis(by: str, name: str) -> DataFrame:
        c = ink.groupBy("image_id", by).agg(F.sum(F.col("ink").cast("long")).alias("c"))
        mean = F.avg("c")
        return c.groupBy("image_id").agg(F.when(mean > 0, F.var_pop("c") / (mean * mean)).otherwise(F.lit(0.0)).alias(name))

    out = axis("y", "across_rows").join(axis("x", "across_columns"), "image_id")
    return out.withColumn("rotation", F.when(F.col("across_columns") > SIDEWAYS * F.col("across_rows"), 90).otherwise(0))


def projection_variance(ink: DataFrame, angles: list[float]) -> DataFrame:
    """(image_id, angle, variance) of ink counts by row after a shear by each angle; rows of the page without ink count as 0."""
    size = ink.groupBy("image_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    dark = ink.filter("ink").join(size, "image_id").withColumn("angle", F.explode(F.array(*[F.lit(float(a)) for a in angles])))
    row = F.floor(F.col("y") + F.tan(F.radians(-F.col("angle"))) * (F.col("x") - F.col("width") / 2.0))
    rows = dark.withColumn("row", row).filter("row >= 0 AND row < height").groupBy("image_id", "angle", "height", "row").agg(F.count("*").alias("c"))
    n = F.first("height").cast("double")
    mean = F.sum("c") / n
    return rows.groupBy("image_id", "angle").agg((F.sum(F.col("c") * F.col("c")) / n - mean * mean).alias("variance"))


SLOPE_POINTS = 120


def theil_sen(x: Column, y: Column) -> Column:
    """(slope, intercept) of a line through points in arrays x and y: the median slope between evenly spaced
    points, at most SLOPE_POINTS of them, and the median intercept of all; null without a slope."""

    def line(x: Column, y: Column) -> Column:
        n = F.size(x)
        step = F.greatest(F.ceil(n / SLOPE_POINTS).cast("int"), F.lit(1))
        points = F.transform(F.sequence(F.lit(0), n - 1, step), lambda i: F.struct(F.get(x, i).alias("x"), F.get(y, i).alias("y")))
        after = lambda ps, k: F.slice(ps, k + 2, F.size(ps))
        rise = lambda p, q: F.when(q["x"] != p["x"], (q["y"] - p["y"]) / (q["x"] - p["x"]))
        pairs = bound(points, lambda ps: F.flatten(F.transform(ps, lambda p, k: F.transform(after(ps, k), lambda q: rise(p, q)))))
        slopes = F.sort_array(F.filter(pairs, lambda s: s.isNotNull()))
        intercept = lambda slope: nearest_rank(F.sort_array(F.zip_with(x, y, lambda a, b: b - slope * a)), 0.5)
        through = lambda slope: F.when(slope.isNotNull(), F.struct(slope.alias("slope"), intercept(slope).alias("intercept")))
        return F.when(n >= 2, bound(bound(slopes, lambda ss: nearest_rank(ss, 0.5)), through))

    # an array that is an expression would be made anew for each of its elements that is asked for
    return bound(F.struct(x.alias("x"), y.alias("y")), lambda p: bound(p["x"], lambda a: bound(p["y"], lambda b: line(a, b))))
