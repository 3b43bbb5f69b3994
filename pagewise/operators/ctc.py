"""Greedy CTC decoding of class scores, by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = 0


def decode_greedy(rows: DataFrame, classes: int, charset: list[str], *, probs: str = "probs") -> DataFrame:
    """rows with text and confidence: arg-max a step (the last of equals), repeats and blanks dropped.

    A step of fewer than `classes` scores at the end is dropped. Confidence is the mean of the kept
    steps' scores, 0 when none is kept. All within the row: no explode, no shuffle.
    """
    p = F.transform(F.col(probs), lambda v: v.cast("double"))
    steps = F.floor(F.size(p) / classes).cast("int")
    at = F.when(steps > 0, F.sequence(F.lit(0), steps - 1)).otherwise(F.array().cast("array<int>"))
    cut = F.transform(at, lambda s: F.slice(p, s * classes + 1, classes))
    best = F.transform(cut, lambda xs: F.array_max(F.transform(xs, lambda v, k: F.struct(v.alias("v"), k.alias("k")))))
    kept = lambda x, k, prev: (x["k"] != BLANK) & ((k == 0) | (x["k"] != prev["k"])) & (x["k"] <= len(charset))
    out = rows.withColumn("_best", best)
    b = F.col("_best")
    chosen = F.filter(b, lambda x, k: kept(x, k, F.get(b, k - 1)))
    out = out.withColumn("_kept", chosen)
    letters = F.array(*[F.lit(c) for c in charset])
    text = F.array_join(F.transform("_kept", lambda x: F.get(letters, x["k"] - 1)), "")
    mean = F.aggregate("_kept", F.lit(0.0), lambda acc, x: acc + x["v"]) / F.size("_kept")
    return out.withColumns({"text": text, "confidence": F.when(F.size("_kept") > 0, mean).otherwise(F.lit(0.0))}).drop("_best", "_kept")
