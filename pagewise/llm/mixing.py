"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Targets. Source s has weight w_s and may be taken at most `max_epochs` times its size c_s. The
budget is shared by weight; a source above its cap is clamped and its excess is shared by weight
among the others until none is above. That fixed point is target_s = min(cap_s, level * w_s) with
one water level for all; over sources in order of cap_s / w_s the clamped ones come first, so
running sums give the level in one pass. Only one row a source takes part in this.

Sampling. A source's epochs are e = target / size: every document is taken floor(e) times and,
in the order of a seeded hash, documents are taken once more while their running size stays
within the rest. Documents above 1/LARGE of their source (at most LARGE of them) come first and
fill their part of the rest; the others fill what is left, so a source misses its target by half a
small document. The order is cut by a histogram of hash slots (at most SLOTS rows a source), and
only the documents of the one slot that holds the cut are ranked, so no source is ever sorted
whole.

Edge cases: a null text has size 0; a null source is a source of its own, the last; a source of
size 0 has target 0; repeated rows are separate documents, and of rows equal in (doc_id, size) as
many are taken as fit; an empty table gives an empty result; other columns are ignored. When all
caps together are below the budget, every source is taken at its cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored

SLOTS = 4096
#: A document is large beyond this part of its source: taking it or not moves the source visibly.
LARGE = 50
#: Sources, in rows of two numbers and a name, up to which their table is broadcast (some MB).
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast for a side counted to be within the bound; else leave the join to Spark."""
    return F.broadcast(df) if rows <= bound else df


def water_fill(sources: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """sources: source, source_size, weight. Adds target and epochs.

    One task sorts the sources; it holds a row a source, never a document.
    """
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_first())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    x = x.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    x = x.withColumn("level_here", level)
    # the level is set by the first source that stays under its cap
    x = x.withColumn("at", F.row_number().over(by_ratio))
    x = x.withColumn("level", F.min(F.when(F.col("cap") > F.col("level_here") * F.col("weight"), F.struct("at", "level_here"))).over(everything)["level_here"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return x.select("source", "source_size", "weight", target.alias("target")).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Weights by the rank of the source's name by code point, null last, repeating the cycle."""
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), at + 1))


def mix(spark: SparkSession, docs: DataFrame, *, share: float = 1.5, max_epochs: float = 2.0, weights=lambda s: cyclic_weights(s, (3.0, 1.0, 2.0)), seed: int = 17, size: Column | None = None) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, epochs, repeats, taken.

    `weights` gets (source, source_size) and adds a column weight > 0. `share` is the budget as a
    part of all sizes. The result's rows are those of docs.
    """
    sized = stored(spark, docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size")), "sizes")
    sources = stored(spark, water_fill(weights(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), max_epochs, share), "sources")
    n = sources.count()
    # rest of the target after whole repetitions
    told = sources.withColumn("cut", F.col("target") - F.floor("epochs") * F.col("source_size")).withColumnRenamed("source", "of")
    x = sized.join(small(told, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    x = x.withColumn("h", F.xxhash64(F.col("doc_id"), F.lit(seed), F.col("size"))).withColumn("slot", F.pmod("h", F.lit(SLOTS)))
    large = F.col("size") * LARGE > F.col("source_size")
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs"]

    # large documents, at most LARGE a source, fill their part of the cut
    in_order = Window.partitionBy("source").orderBy("h", "doc_id", "size")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.partitionBy("source")
    tops = x.filter(large).withColumn("done", F.coalesce(F.sum("size").over(before), F.lit(0)))
    tops = tops.withColumn("part", F.col("cut") / F.col("source_size") * F.sum("size").over(of_all))
    tops = stored(spark, tops.select(*cols, (F.col("done") + F.col("size") / 2 < F.col("part")).cast("long").alias("more")), "large")

    # the others fill what is left: whole slots before the cut, and a part of the slot across it
    left = tops.groupBy("source").agg(F.sum(F.col("more") * F.col("size")).alias("large_taken")).withColumnRenamed("source", "by")
    slots = x.filter(~large & (F.col("size") > 0)).groupBy("source", "slot", "cut").agg(F.sum("size").alias("slot_size"))
    by_slot = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(by_slot), F.lit(0)))
    slots = slots.join(small(left, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("by")), "left")
    slots = slots.withColumn("cut", F.col("cut") - F.coalesce("large_taken", F.lit(0)))
    edge = slots.filter((F.col("before") < F.col("cut")) & (F.col("cut") < F.col("before") + F.col("slot_size")))
    whole = slots.filter(F.col("before") + F.col("slot_size") <= F.col("cut"))
    ends = whole.groupBy("source").agg(F.max("slot").alias("last_whole")).withColumnRenamed("source", "by")
    edge = edge.select(F.col("source").alias("by2"), F.col("slot").alias("edge_slot"), (F.col("cut") - F.col("before")).alias("edge_cut"))
    cuts = sources.select(F.col("source").alias("of")).join(ends, F.col("of").eqNullSafe(F.col("by")), "left").join(edge, F.col("of").eqNullSafe(F.col("by2")), "left")
    cuts = stored(spark, cuts.select("of", "last_whole", "edge_slot", "edge_cut"), "cuts")
    x = x.filter(~large).join(small(cuts, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    at_edge = F.coalesce(F.col("slot") == F.col("edge_slot"), F.lit(False))
    inside = F.coalesce(F.col("slot") <= F.col("last_whole"), F.lit(False))
    plain = x.filter(~at_edge).select(*cols, inside.cast("long").alias("more"))
    edges = x.filter(at_edge).withColumn("done", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # the document across the cut is taken when more than half of it lies before the cut
    edges = edges.select(*cols, (F.col("done") + F.col("size") / 2 < F.col("edge_cut")).cast("long").alias("more"))
    out = tops.unionByName(plain).unionByName(edges).withColumn("repeats", F.floor("epochs") + F.col("more"))
    return out.drop("more").withColumn("taken", F.col("repeats") * F.col("size"))
