"""MinHash near-dedup as a chosen-path set similarity join.

Documents with the same shingle set are one class. Classes get POSITIONS minwise hashes, POOL of them
a tree. Each of TREES independent trees branches them: a node of the tree (a path) chooses BRANCHES
positions of its tree's pool by a hash of its own path, and sends each class to the child named by the
class's minwise token there. Small nodes are compared exhaustively; larger ones branch again, and
again, until they are small or branching wouldn't pay: it makes BRANCHES rows of each, and of the pairs
to compare in a node whose classes agree at the part a of positions it leaves the part BRANCHES a. Where
that is SETTLED or more, as among near copies, no token parts them, and where n (1 - BRANCHES a) is LEAF
or less, the pairs saved cost less than the rows made; either node is compared as it is. Two sets of
similarity s miss each other in a node with probability f = (1 - s (1 - f'))^2, f' that of its children
and 0 where nodes are compared: however deep, at most 0.031 a tree for s = 0.85, so four trees lose one
link in a million; for s = 0.8 at most 0.0625, one in 65,000.

A node is compared on full shingle sets. What is asked for is connection, so a pair already connected
within the node is skipped and a node yields spanning links only, never all pairs. Nodes beyond BLOCK
classes are dealt into blocks that share a few pivots; after connecting, every class of such a node
outside the node's largest component is compared with all blocks of the node, which covers each pair of
classes not connected yet.

Joins by path can meet a path that many classes take; they are plain equi-joins with a row a path on
one side, which adaptive execution splits where a partition is skewed.

Edge cases: null texts and texts without words have no shingles, are linked with nothing and are
kept; a null doc_id is kept, its component_id is that of its class (null when all are); repeated
rows are members of one class and carry the same component_id; extra columns stay untouched;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, byte_texts, column, dropped, lower_word_hashes, shingle_set, stored, unused_name

TREES, BRANCHES, PER_LEVEL, POOL = 4, 2, 4, 16
POSITIONS = TREES * POOL
#: Levels after which a path has met its tree's positions over and over: what it holds won't part.
LEVELS = 6
#: The part of a node's pairs left by branching, from which on the node is compared instead.
SETTLED = 0.8
#: Classes that one is compared with at the cost, by estimate, of one more row of it.
LEAF = 256
BLOCK, PIVOTS = 384, 4
ROWS_A_TASK = 250_000
_A = np.random.default_rng(20).integers(1, 2**63, POSITIONS, dtype=np.uint64) * U(2) + U(1)
_B = np.random.default_rng(21).integers(1, 2**63, POSITIONS, dtype=np.uint64)


def minhash(s: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens of a set, as int32."""
    out = np.full(POSITIONS, 2**64 - 1, np.uint64)
    for at in range(0, len(s), 4096):
        out = np.minimum(out, (s[at : at + 4096, None] * _A + _B).min(axis=0))
    return (out >> U(32)).astype(np.uint32).view(np.int32)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, cls, sigs = [], [], []
        for raw in byte_texts(batch.column(2)):
            s = shingle_set(lower_word_hashes(raw or b""))
            n.append(len(s))
            cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(minhash(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "digest", "n_shingles", "cls", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, text) to (cls, shingle set), where the text still has that set; a null cls takes the text's."""
    for batch in batches:
        cls, sets = [], []
        for want, raw in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), strict=True):
            s = shingle_set(lower_word_hashes(raw or b""))
            found = xxhash.xxh3_128_digest(s.tobytes())
            if len(s) and found == (want or found):
                cls.append(found)
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(sets, pa.binary())], names=["cls", "shingles"])


def grouped(df: DataFrame, keys: list[str], fn: Callable[[list[dict]], list[tuple]], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """fn over the rows of each key, by streaming through sorted partitions: one Python call a task
    instead of one a group. A group's rows must be bounded by the caller."""

    def run(batches):
        held, key = [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                k = tuple(row[x] for x in keys)
                if k != key and held:
                    out += fn(held)
                    held = []
                key = k
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if held and (out := fn(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def spanning_links(sets: list[np.ndarray], known: list, threshold: int) -> list[tuple[int, int]]:
    """Links between sets with 100 * intersection >= threshold * union, enough of them to connect
    all that are linked. known: a label for each set; equal labels are connected already."""
    n = len(sets)
    label = {}
    of = np.array([label.setdefault(k, len(label)) for k in known])
    sizes = np.array([len(s) for s in sets])
    _, which = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    links, mark = [], np.zeros(which.max() + 1, bool)
    home = int(np.flatnonzero(of == np.bincount(of).argmax())[0])
    # home's component asks nothing where it is known; where nothing is, home asks first
    turns = range(n) if len(label) < n else [home, *(p for p in range(n) if p != home)]
    for turn, p in enumerate(turns):
        if of[p] == of[home] and (turn or len(label) < n):
            continue
        others = np.flatnonzero(of != of[p])
        if not len(others):
            break
        others = others[100 * np.minimum(sizes[others], sizes[p]) >= threshold * np.maximum(sizes[others], sizes[p])]
        if not len(others):
            continue
        mark[which[starts[p] : ends[p]]] = True
        if len(others) > n // 8:
            shared = np.add.reduceat(mark[which], starts, dtype=np.int64)[others]
        else:
            shared = np.array([np.count_nonzero(mark[which[starts[q] : ends[q]]]) for q in others])
        mark[which[starts[p] : ends[p]]] = False
        near = 100 * shared >= threshold * (sizes[others] + sizes[p] - shared)
        for q in others[near]:
            if of[q] != of[p]:
                links.append((p, int(q)))
                of[of == of[q]] = of[p]
    return links


def _compare(threshold: int) -> Callable[[list[dict]], list[tuple]]:
    def fn(rows: list[dict]) -> list[tuple]:
        if len(rows) < 2:
            return []
        rows = list({r["cls"]: r for r in rows}.values())
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        return [(rows[a]["cls"], rows[b]["cls"]) for a, b in spanning_links(sets, [r["comp"] for r in rows], threshold)]

    return fn


def connected_components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links (a, b) to (cls, comp): comp is the smallest member of the component.

    Labels fall to the least neighbour's and then to the label's own label (pointer jumping) until
    nothing changes, so long chains take few rounds. Each round is a written table, by as many tasks
    as its rows need: a few links over many partitions would else cost a task a partition a round.
    """
    both = stored(spark, links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    tasks = -(-both.count() // ROWS_A_TASK) or 1
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("cls"), F.least("a", "least").alias("comp"))
    labels = stored(spark, labels.coalesce(tasks), "labels")
    while True:
        before = labels
        step = both.join(labels.select(F.col("cls").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        step = labels.select("cls", "comp").join(step.withColumnRenamed("a", "cls"), "cls").select("cls", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        step = stored(spark, step.coalesce(tasks), "labels")
        jump = step.select(F.col("cls").alias("comp"), F.col("comp").alias("to"))
        new = stored(spark, step.join(jump, "comp").select("cls", "was", F.col("to").alias("comp")).coalesce(tasks), "labels")
        dropped(spark, before, step)
        labels = new
        if not new.filter(F.col("was") != F.col("comp")).limit(1).count():
            dropped(spark, both)
            return new.select("cls", "comp")


def _roots(sig: Column) -> Column:
    """The nodes under the root of each tree, BRANCHES a tree; their positions are fixed."""
    return F.array(*[F.xxhash64(F.lit(t), F.lit(p), sig[t * POOL + p]) for t in range(TREES) for p in range(BRANCHES)])


def _children(level: int, path: Column, tree: Column, sig: Column) -> Column:
    """The children that a node sends a class to: hashes of (path, position, token there)."""
    first = F.pmod(path, F.lit(PER_LEVEL)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.shiftright(path, 20), F.lit(PER_LEVEL - 1)).cast("int"), F.lit(PER_LEVEL))
    pool = tree * POOL + level * PER_LEVEL % POOL
    return F.array(*[F.xxhash64(path, p, F.element_at(sig, pool + p + 1)) for p in (first, second)])


def _pivots() -> Column:
    """An aggregate by path: PIVOTS classes of the node, by a hash of its own."""
    return F.array(*[F.min(F.struct(F.xxhash64("cls", "path", F.lit(k)).alias("h"), "cls"))["cls"] for k in range(PIVOTS)])


def _settled(nodes: DataFrame, sigs: DataFrame) -> DataFrame:
    """The paths of large nodes (path, n, cls) that branching makes no cheaper to compare, as far as their
    classes agree with a few of them."""
    pivots = nodes.groupBy("path").agg(_pivots().alias("cls")).select("path", F.explode("cls").alias("cls"))
    pivots = pivots.join(sigs, "cls").groupBy("path").agg(F.collect_list("sig").alias("of"))
    agree = F.transform("of", lambda of: F.size(F.filter(F.zip_with("sig", of, lambda a, b: a == b), lambda x: x)))
    part = F.aggregate(agree, F.lit(0), lambda a, b: a + b) / (F.size("of") * POSITIONS)
    left = nodes.join(sigs, "cls").join(pivots, "path").groupBy("path", "n").agg((BRANCHES * F.avg(part)).alias("left"))
    return left.filter((F.col("left") >= SETTLED) | (F.col("n") * (1 - F.col("left")) <= LEAF)).select("path")


def _nodes(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(path, cls, n, late) of every node to be compared: small ones, and those that branching won't part.
    late is false under the first branch of the first tree."""
    sigs = classes.select("cls", "sig")
    at = sigs.select("cls", F.posexplode(_roots(F.col("sig"))).alias("spot", "path"))
    at = at.select("cls", F.floor(F.col("spot") / BRANCHES).cast("int").alias("tree"), (F.col("spot") > 0).alias("late"), "path")
    parts, scratch = [], []
    for level in range(1, LEVELS + 1):
        counts = at.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
        here = stored(spark, at.join(counts, "path"), "nodes")
        scratch.append(here)
        large = here.filter(F.col("n") > LEAF)
        if level == LEVELS or not large.limit(1).count():
            parts.append(here)
            break
        settled = stored(spark, _settled(large, sigs), "settled")
        done = stored(spark, here.filter(F.col("n") <= LEAF).unionByName(large.join(settled, "path", "left_semi")), "nodes")
        scratch += [settled, done]
        parts.append(done)
        at = large.join(settled, "path", "left_anti").join(sigs, "cls").select("cls", "tree", "late", F.explode(_children(level, F.col("path"), F.col("tree"), F.col("sig"))).alias("path"))
        at = stored(spark, at, "children")  # read twice: counted, and joined with the counts
        scratch.append(at)
    found = reduce(DataFrame.unionByName, [p.select("path", "cls", "n", "late") for p in parts])
    # nodes with the same members are compared once
    prints = [F.bit_xor(F.xxhash64("cls", F.lit(k))).alias(f"print{k}") for k in range(2)]
    of = found.groupBy("path", "late").agg(F.first("n").alias("n"), *prints)
    one = of.groupBy("n", "print0", "print1").agg(F.min(F.struct("late", "path"))["path"].alias("path"))
    out = stored(spark, found.join(one.select("path"), "path", "left_semi"), "nodes")
    dropped(spark, *scratch)
    return out


_LINK = ("a binary, b binary", ["a", "b"], [pa.binary(), pa.binary()])


def _needed_sets(spark: SparkSession, docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    need = nodes.select("cls").distinct().join(classes.select("cls", "rep"), "cls")
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(need.filter("rep is not null"), "rep").select("cls", "text")
    sets = texts.mapInArrow(_sets, "cls binary, shingles binary")
    # classes that have no doc_id at all are found by their sets among the rows without one
    nameless = need.filter("rep is null").select("cls")
    if nameless.limit(1).count():
        bare = docs.filter("doc_id is null").select(F.lit(None).cast("binary").alias("cls"), "text")
        sets = sets.unionByName(bare.mapInArrow(_sets, "cls binary, shingles binary").join(nameless, "cls", "left_semi"))
    return stored(spark, sets.dropDuplicates(["cls"]), "sets")


def link_classes(spark: SparkSession, docs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """(cls, comp) of every class linked with another one.

    The first branch of the first tree finds most links. All other nodes are then compared only
    where their classes aren't in one component yet.
    """
    nodes = _nodes(spark, classes)
    sets = _needed_sets(spark, docs, classes, nodes)
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    nodes = nodes.withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    early = nodes.filter(~F.col("late"))
    # pivots: a few classes of each large node, in all its blocks
    pivots = early.filter("parts > 1").groupBy("path", "parts").agg(_pivots().alias("tops")).select("path", "parts", F.explode("tops").alias("cls"))
    pivots = pivots.select("path", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    first = early.select("path", "cls", "block").unionByName(pivots).join(sets, "cls").withColumn("comp", F.col("cls"))
    links = stored(spark, grouped(first, ["path", "block"], _compare(threshold), *_LINK), "links")
    labels = connected_components(spark, links)

    told = nodes.filter("late or parts > 1").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    told = stored(spark, told, "told")
    sizes = told.groupBy("path", "comp").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("path").agg(F.max_by("comp", F.struct("size", "comp")).alias("most"), F.ceil((F.sum("size") - F.max("size")) / BLOCK).cast("int").alias("lots"), F.count("*").alias("comps")).filter("comps > 1")
    told = stored(spark, told.join(mixed, "path").drop("late", "comps"), "mixed")
    plain = told.filter("parts = 1").select("path", "block", F.lit(0).alias("lot"), "cls", "comp")
    # in a large node, classes outside its largest component, in lots, meet every block
    large = told.filter("parts > 1").withColumn("lot", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("lots")).cast("int"))
    asks = large.filter(F.col("comp") != F.col("most")).select("path", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), "lot", "cls", "comp")
    met = large.select("path", "block", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "cls", "comp")
    second = plain.unionByName(asks).unionByName(met).join(sets, "cls")
    more = stored(spark, grouped(second, ["path", "block", "lot"], _compare(threshold), *_LINK), "links")
    if not more.limit(1).count():
        return labels
    return connected_components(spark, links.unionByName(more))


def _judged(spark: SparkSession, docs: DataFrame, threshold: int) -> DataFrame:
    """(doc_id, digest, n_shingles, cls, comp, component_id) of docs (doc_id, digest, text), by row."""
    rows = stored(spark, docs.mapInArrow(_profiles, "doc_id bigint, digest string, n_shingles bigint, cls binary, sig array<int>"), "profiles")
    classes = stored(spark, rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")
    labels = link_classes(spark, docs.drop("digest"), classes, threshold)
    of = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    ids = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return rows.drop("sig").join(of.join(ids, "comp").select("cls", "comp", "component_id"), "cls", "left")


def components(spark: SparkSession, docs: DataFrame, *, threshold: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Links hold where 100 * intersection >= threshold * union of the sets of distinct 5-word shingles.
    """
    out = _judged(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit("").alias("digest"), "text"), threshold)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, *, threshold: int = 80) -> DataFrame:
    """One document of each component, with its own columns: the one with the least doc_id (null last),
    and of those with one doc_id the one with the least digest of its text.

    Rows are told apart by doc_id and text, so different texts under one doc_id are judged apart; of
    rows equal in both one stays. Texts without words are linked with nothing and all stay.
    """
    key = unused_name(docs, "_row")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    digest = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.md5(F.encode("text", "UTF-8")))
    judged = _judged(spark, docs.filter(has_words).select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), "text"), threshold)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest"))
    kept = stored(spark, judged.groupBy("comp").agg(best.alias("best"), F.count("*").alias("n")).select(F.col("best.digest").alias(key), "n"), "kept")
    worded = docs.filter(has_words).withColumn(key, digest)
    if kept.filter("n > 1").limit(1).count():  # else no row can repeat another one
        worded = worded.dropDuplicates([key])
    worded = worded.join(kept.select(key), key, "left_semi")
    cols = [column(c) for c in docs.columns]
    return worded.select(*cols).unionByName(docs.filter(~has_words).select(*cols))
