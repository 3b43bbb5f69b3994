"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle set (powers of two). An item's sketch is its
bottom-k minwise hashes, with k from its partition's upper size u: k = floor((1 - t) u) + 1. A
text that contains the part t or more of an item lacks at most floor((1 - t) q) <= k - 1 of its q
shingles, so it must hold one of the sketch's hashes: candidate search loses nothing, however long
the text and wherever the shingles lie. Candidates are verified by exact shingle containment while
the text's shingles are at hand, so one pass over the texts does it all, without a shuffle.

Items are taken in blocks of at most BLOCK_SHINGLES shingles; each block is one such pass, so what
a task holds is bounded however many items there are.

Edge cases: a null or empty item, or text, has no words and matches nothing; an item of fewer
words than a shingle is one shingle of its own length; items and texts may repeat, and each pair
of rows with matching ids gives one row a pair of rows; a null doc_id or item_id is carried; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, byte_texts, gram_hashes, lower_word_hashes, mixed, shingle_set

BLOCK_SHINGLES = 1_000_000
SHINGLE = 5


class Index:
    """Sketches and shingle sets of one block of items, by length of shingle."""

    def __init__(self, items: list[tuple[int | None, np.ndarray, int]], threshold: int):
        """items: (item_id, shingle set, words a shingle). threshold: per cent of an item's set."""
        self.items, self.threshold = items, threshold
        self.sketch: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {x[2] for x in items}:
            hashes, owners = [], []
            for at, (_, s, length) in enumerate(items):
                if length == n and len(s):
                    upper = 1 << (len(s) - 1).bit_length()
                    k = min(len(s), (100 - threshold) * upper // 100 + 1)
                    order = mixed(s ^ U(0x5BD1E995))
                    hashes.append(s[np.argpartition(order, k - 1)[:k]])
                    owners.append(np.full(k, at))
            h, o = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            self.sketch[n] = h[order], o[order]

    def matches(self, h: np.ndarray) -> list[tuple[int | None, int, int]]:
        """(item_id, set size, shared) of the items that a text with these word hashes contains."""
        out = []
        for n, (keys, owners) in self.sketch.items():
            if len(h) < n:
                continue
            grams = gram_hashes(h, n)
            # texts are longer than sketches are many: look grams up in the sorted sketch
            lo = np.searchsorted(keys, grams, "left")
            lo[lo == len(keys)] = 0
            hit = keys[lo] == grams
            if not hit.any():
                continue
            mine = np.unique(grams)
            found = np.unique(grams[hit])
            first, last = np.searchsorted(keys, found, "left"), np.searchsorted(keys, found, "right")
            for at in sorted({o for a, b in zip(first, last, strict=True) for o in owners[a:b].tolist()}):
                item, s, _ = self.items[at]
                shared = int(np.isin(s, mine, assume_unique=True).sum())
                if 100 * shared >= self.threshold * len(s):
                    out.append((item, len(s), shared))
        return out


def item_blocks(items: list[tuple[int | None, str | None]]) -> Iterator[list[tuple[int | None, np.ndarray, int]]]:
    block, held = [], 0
    for item, text in items:
        h = lower_word_hashes((text or "").encode())
        if len(h):
            s = shingle_set(h, SHINGLE)
            block.append((item, s, min(SHINGLE, len(h))))
            held += len(s)
            if held >= BLOCK_SHINGLES:
                yield block
                block, held = [], 0
    if block:
        yield block


def _indexes(spark: SparkSession, benchmark: DataFrame, threshold: int):
    """A broadcast index of each block. Items stream through the driver, a partition at a time."""
    rows = ((r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator())
    for block in item_blocks(rows):
        yield spark.sparkContext.broadcast(Index(block, threshold))


_ROWS = "doc_id bigint, item_id bigint, n_item_shingles bigint, n_shared bigint"


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: int = 80) -> DataFrame:
    """Pairs (doc_id, item_id, n_item_shingles, n_shared) with 100 * shared >= threshold * item's set."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], _ROWS)
    for index in _indexes(spark, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for doc, raw in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
                    if raw:
                        found += [(doc, *m) for m in index.value.matches(lower_word_hashes(raw))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

        out = out.unionByName(docs.mapInArrow(run, _ROWS))
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, threshold: int = 80) -> DataFrame:
    """The documents that contain no benchmark item, with their own columns: a filter in one pass."""
    for index in _indexes(spark, benchmark, threshold):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = byte_texts(batch.column(batch.schema.get_field_index("text")))
                yield batch.filter(pa.array([not (raw and index.value.matches(lower_word_hashes(raw))) for raw in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
