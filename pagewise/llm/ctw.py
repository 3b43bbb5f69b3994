"""LM scoring by context-tree weighting over bytes.

A byte is decomposed into eight binary decisions, each made at a node of the byte's prefix tree. For
every such node there is a context tree over the DEPTH bytes before, and Krichevsky-Trofimov
estimates at all its depths are mixed by weighting: P_w = (P_e + product of the children's P_w) / 2.
Texts are scored by the model that training leaves, so the code length of a byte is the same
wherever its context is. A text's end is a byte of its own (0xFF, which UTF-8 hasn't), and contexts
before its start are zero bytes.

Training and scoring need only counts of (context, byte) grams, and those of a chunk of documents
are few. Each chunk sends its distinct grams with their training counts, once each, to buckets of
the last two context bytes. A bucket holds whole subtrees below depth two, so it does the weighting
bottom-up, some subtrees at a time, and gives each chunk the log-probability of each of its grams.
What subtrees add to depth one is summed by key, at most 256 x 255 rows, which the driver turns into
the table of depths zero and one. Words for the unigram base go the same way, by 64-bit hashes; ends
are counted apart. Nothing that grows with the corpus is broadcast or collected, and a chunk sends
at most 2 x BUCKETS blobs, however many chunks there are.

Edge cases: a null text is empty: it has one token, the end; a null doc_id belongs to the training
part; repeated rows are counted and scored each; an empty table gives an empty result; extra
columns are ignored. Without any training text all estimates are 1/2.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, byte_texts, chunked, mixed, pack, pack_keys, placed_word_hashes, stored, unpack, unpack_keys

DEPTH = 5
#: Text of a chunk, and of the part of one that is worked on at a time; grams of the subtrees that are.
CHUNK_BYTES, PART, SUBTREES = 24 << 20, 4 << 20, 1 << 18
#: Buckets a chunk, several, so that those that share a task even out; and at most: contexts of two bytes, the
#: unit that grams are dealt by.
PER_CHUNK, BUCKETS = 4, 1 << 16
_GRAMS, _WORDS = 0, 1


def is_held_out(doc_id: int | None, modulus: int, remainder: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


# ---------------------------------------------------------------- the tree


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - math.log(math.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving x up by 8."""
    x = np.asarray(x, float)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    x = x + 8
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - shift


class Nodes:
    """The nodes (context, byte prefix) of one depth, from sorted grams (context << 8 | byte)."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        self.grams = grams
        keys, zeros, ones, self.of = [], [], [], []
        at = 0
        for level in range(8):
            byte = grams & U(0xFF)
            prefix = (U(1) << U(level)) | (byte >> U(8 - level))
            key = (grams >> U(8) << U(8)) | prefix
            new = np.append(True, key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            one = np.where((byte >> U(7 - level)) & U(1), counts, 0)
            total, up = np.add.reduceat(counts, starts), np.add.reduceat(one, starts)
            keys.append(key[starts])
            zeros.append(total - up)
            ones.append(up)
            self.of.append(at + np.cumsum(new) - 1)  # node of each gram at this level
            at += len(starts)
        self.keys = np.concatenate(keys)
        order = np.argsort(self.keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.keys, self.of = self.keys[order], [place[x] for x in self.of]
        self.zeros, self.ones = np.concatenate(zeros)[order], np.concatenate(ones)[order]
        self.log_e = log_kt(self.zeros, self.ones)
        self.kt_one = (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def shorter(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of one context byte less: the oldest byte, the lowest of the context, goes."""
    cut = (grams >> U(16) << U(8)) | (grams & U(0xFF))
    out, which = np.unique(cut, return_inverse=True)
    return out, np.bincount(which, counts, len(out)).astype(np.int64)


def parents(keys: np.ndarray, above: np.ndarray) -> np.ndarray:
    return np.searchsorted(above, (keys >> U(16) << U(8)) | (keys & U(0xFF)))


def weigh(levels: list[Nodes], below: np.ndarray | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """log P_w and the weight of stopping, of the nodes of each level; levels from shallow to deep.
    below: log P_w of subtrees under the deepest level, summed by node; else it stops there."""
    log_w, stop = [None] * len(levels), [None] * len(levels)
    for d in range(len(levels) - 1, -1, -1):
        here = levels[d]
        if d == len(levels) - 1:
            rest = below
        else:
            rest = np.bincount(parents(levels[d + 1].keys, here.keys), log_w[d + 1], len(here.keys))
        if rest is None:
            log_w[d], stop[d] = here.log_e, np.ones(len(here.keys))
        else:
            log_w[d] = np.logaddexp(here.log_e, rest) - math.log(2)
            stop[d] = np.exp(here.log_e - math.log(2) - log_w[d])
    return log_w, stop


def descend(levels: list[Nodes], stop: list[np.ndarray], got: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixed probability of a one, and the weight left for deeper nodes, at the deepest level; got and
    left: what the nodes above the first level have added, by its nodes."""
    for d, here in enumerate(levels):
        if d:
            up = parents(here.keys, levels[d - 1].keys)
            got, left = got[up], left[up]
        got = got + left * stop[d] * here.kt_one
        left = left * (1 - stop[d])
    return got, left


def tree_levels(grams: np.ndarray, counts: np.ndarray, deepest: int, shallowest: int) -> list[Nodes]:
    levels = [Nodes(grams, counts)]
    for d in range(deepest, shallowest, -1):
        grams, counts = shorter(grams, counts, d)
        levels.append(Nodes(grams, counts))
    return levels[::-1]


# ---------------------------------------------------------------- chunks


class Chunk:
    """The documents of a chunk, worked on in parts of about PART bytes."""

    def __init__(self, table: pa.Table, depth: int, modulus: int, remainder: int):
        self.ids = table.column("doc_id").to_pylist()
        self.held = np.array([is_held_out(i, modulus, remainder) for i in self.ids], bool)
        self.depth, self.texts = depth, table.column("text")

    def parts(self) -> Iterator[tuple[int, list[bytes]]]:
        """(number of the first document, texts), a part at a time."""
        first, held, size = 0, [], 0
        for k in range(len(self.ids)):
            held += [t or b"" for t in byte_texts(self.texts.slice(k, 1))]
            size += len(held[-1])
            if size >= PART:
                yield first, held
                first, held, size = k + 1, [], 0
        if held:
            yield first, held

    def grams(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The gram of every byte and end, and the document of each. The newest context byte is the
        uppest, so grams in order have subtrees together."""
        pad = b"\0" * self.depth
        data = np.frombuffer(pad.join([b"", *[t + b"\xff" for t in texts]]) + bytes(8), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(doc)) + (doc + 1) * self.depth
        # eight bytes from each place on, read at once; those of the context have the newest uppest
        eight = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
        context = eight[at - self.depth] & U((1 << 8 * self.depth) - 1)
        return context << U(8) | data[at], doc

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every word, and the document of each. Ends aren't among them."""
        h, at = placed_word_hashes(b"\n".join(texts))
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        return h, np.searchsorted(starts, at, "right") - 1

    def counted(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, sorted keys, training counts) of the distinct grams and words."""
        found = {_GRAMS: [], _WORDS: []}
        for first, texts in self.parts():
            held = self.held[first : first + len(texts)]
            for kind, (keys, doc) in ((_GRAMS, self.grams(texts)), (_WORDS, self.words(texts))):
                which, distinct = pd.factorize(keys)  # by hashing; only distinct keys are sorted
                found[kind].append((distinct, np.bincount(which[~held[doc]], minlength=len(distinct))))
        out = []
        for kind, parts in found.items():
            keys, which = np.unique(np.concatenate([k for k, _ in parts] or [np.zeros(0, np.uint64)]), return_inverse=True)
            n = np.bincount(which, np.concatenate([c for _, c in parts] or [np.zeros(0)]), len(keys))
            out.append((kind, keys, n.astype(np.int64)))
        return out


def _bucket(keys: np.ndarray, kind: int, depth: int, buckets: int) -> np.ndarray:
    """Grams by their two newest context bytes, words by their hash."""
    if kind == _GRAMS:
        keys = mixed(keys >> U(8 * (depth - 1)))
    return (keys % U(buckets)).astype(np.int64)


def _lots(keys: np.ndarray, kind: int, depth: int, buckets: int) -> list[tuple[int, np.ndarray]]:
    """(bucket, places) of sorted keys; a bucket's places are in order."""
    b = _bucket(keys, kind, depth, buckets)
    order = np.argsort(b, kind="stable")
    edges = np.searchsorted(b[order], np.arange(buckets + 1))
    return [(i, order[edges[i] : edges[i + 1]]) for i in range(buckets) if edges[i] < edges[i + 1]]


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_BLOBS = (["kind", "bucket", "chunk", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])
_BLOBS_DDL = "kind int, bucket int, chunk int, blob binary"


def _send(depth: int, modulus: int, remainder: int, buckets: int):
    def fn(table: pa.Table) -> pa.Table:
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table, depth, modulus, remainder)
        rows = []
        for kind, keys, n in chunk.counted():
            rows += [(kind, b, number, pack_keys(keys[at], n[at])) for b, at in _lots(keys, kind, depth, buckets)]
        return _rows(rows, *_BLOBS)

    return fn


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of a bucket, their counts, and each chunk's places among them."""
    lists = [unpack_keys(b, np.int64) for b in table.column("blob").to_pylist()]
    keys = np.unique(np.concatenate([x[0] for x in lists]))
    counts, places = np.zeros(len(keys), np.int64), []
    for k, n in lists:
        places.append(np.searchsorted(keys, k))
        counts[places[-1]] += n
    return keys, counts, places


def _subtrees(keys: np.ndarray, depth: int) -> Iterator[slice]:
    """Ranges of sorted grams that hold whole subtrees below depth two, of about SUBTREES grams each, so
    that the nodes of a few subtrees are held at a time, and not a bucket's."""
    pair = keys >> U(8 * (depth - 1))
    ends = np.flatnonzero(np.append(pair[1:] != pair[:-1], True)) + 1
    lo = 0
    while lo < len(keys):
        hi = int(ends[min(np.searchsorted(ends, lo + SUBTREES), len(ends) - 1)])
        yield slice(lo, hi)
        lo = hi


_SUMMARY = (["kind", "key", "zeros", "ones", "log_w"], [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()])
_SUMMARY_DDL = "kind int, key bigint, zeros bigint, ones bigint, log_w double"


def _summarise(depth: int):
    """Of grams: what subtrees add to the nodes at depth one, counts and log P_w. Of words, in the places of
    counts: how many, and how many distinct."""

    def fn(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        keys, counts, _ = _merged(table)
        if kind == _WORDS:
            return _rows([(kind, 0, int(counts.sum()), int((counts > 0).sum()), 0.0)], *_SUMMARY)
        out = []
        for some in _subtrees(keys, depth):
            levels = tree_levels(keys[some], counts[some], depth, 2)
            two, (log_w, *_) = levels[0], weigh(levels)[0]
            one, which = np.unique((two.keys >> U(16) << U(8)) | (two.keys & U(0xFF)), return_inverse=True)
            out.append([one.astype(np.int64), *(np.bincount(which, x, len(one)) for x in (two.zeros, two.ones, log_w))])
        one, zeros, ones, log_w = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([pa.array(np.full(len(one), _GRAMS, np.int32)), pa.array(one), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(log_w)], names=_SUMMARY[0])

    return fn


class Top:
    """Depths zero and one: got and left for each node of depth one, by its key. At most 256 x 255 nodes."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_w: np.ndarray):
        """Sorted keys of depth one, with counts and the log P_w of what lies below."""
        root, which = np.unique(keys & U(0xFF), return_inverse=True)
        levels = [self._nodes(root, np.bincount(which, zeros, len(root)), np.bincount(which, ones, len(root))), self._nodes(keys, zeros, ones)]
        _, stop = weigh(levels, log_w)
        n = len(root)
        self.keys = keys
        self.got, self.left = descend(levels, stop, np.zeros(n), np.ones(n))

    @staticmethod
    def _nodes(keys, zeros, ones) -> Nodes:
        out = Nodes.__new__(Nodes)
        out.keys, out.zeros, out.ones = keys, zeros, ones
        out.log_e = log_kt(zeros, ones)
        out.kt_one = (ones + 0.5) / (zeros + ones + 1.0)
        return out


def _answer(depth: int, top):
    """To each chunk: its grams with their log10 probabilities (float32), or its words with their training counts."""

    def fn(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        keys, counts, places = _merged(table)
        values = counts
        if kind == _GRAMS:
            values = np.empty(len(keys), np.float32)
            for some in _subtrees(keys, depth):
                levels = tree_levels(keys[some], counts[some], depth, 2)
                _, stop = weigh(levels)
                at = np.searchsorted(top.value.keys, (levels[0].keys >> U(16) << U(8)) | (levels[0].keys & U(0xFF)))
                got, _ = descend(levels, stop, top.value.got[at], top.value.left[at])
                deepest, log_p = levels[-1], np.zeros(some.stop - some.start)
                for level in range(8):
                    one = got[deepest.of[level]]
                    up = (keys[some] >> U(7 - level)) & U(1)
                    log_p += np.log10(np.where(up, one, 1 - one))
                values[some] = log_p
        chunks = table.column("chunk").to_pylist()
        return _rows([(kind, bucket, c, pack_keys(keys[p], values[p])) for c, p in zip(chunks, places, strict=True)], *_BLOBS)

    return fn


_RESULT = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "bits_per_byte": pa.float64()}
_RESULT_DDL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"


def _score(depth: int, modulus: int, remainder: int, tokens: int, distinct: int, ends: int):
    def fn(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([], list(_RESULT), list(_RESULT.values()))
        chunk = Chunk(docs, depth, modulus, remainder)
        model = {}
        for kind, dtype in ((_GRAMS, np.float32), (_WORDS, np.int64)):
            parts = [unpack_keys(b, dtype) for k, b in zip(told.column("kind").to_pylist(), told.column("blob").to_pylist(), strict=True) if k == kind]
            keys, values = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, dtype))
            order = np.argsort(keys)
            model[kind] = keys[order], values[order]

        def values_of(kind: int, keys: np.ndarray) -> np.ndarray:
            which, found = pd.factorize(keys)
            known, values = model[kind]
            return values[np.searchsorted(known, found)][which]

        log_unseen = math.log10(tokens + distinct + 1)
        rows = []
        for first, texts in chunk.parts():
            grams, doc = chunk.grams(texts)
            score = np.add.reduceat(values_of(_GRAMS, grams), np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), dtype=np.float64)
            words, doc = chunk.words(texts)
            counts = values_of(_WORDS, words)
            n, known = np.bincount(doc, minlength=len(texts)), np.bincount(doc[counts > 0], minlength=len(texts))
            base = np.bincount(doc, np.log10(counts + 1), len(texts)) + math.log10(ends + 1) - (n + 1) * log_unseen
            for i, text in enumerate(texts):
                size = len(text) + 1
                rows.append((chunk.ids[first + i], bool(chunk.held[first + i]), int(n[i]) + 1, int(known[i]) + int(ends > 0), tokens, float(base[i]), float(score[i]), size, float(-score[i] * math.log2(10) / size)))
        return _rows(rows, list(_RESULT), list(_RESULT.values()))

    return fn


def score_texts(spark: SparkSession, docs: DataFrame, *, depth: int = DEPTH, modulus: int = 7, remainder: int = 2, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of
    the text with its end), n_bytes (with the end) and bits_per_byte.

    Learns from the rows whose crc32(doc_id as text) mod `modulus` isn't `remainder`. depth: 3 to 7.
    """
    table, n = chunked(spark, docs, chunk_bytes)
    buckets = min(n * PER_CHUNK, BUCKETS)
    by_chunk = table.groupBy("chunk")
    sent = stored(spark, by_chunk.applyInArrow(_send(depth, modulus, remainder, buckets), _BLOBS_DDL), "grams")
    by_bucket = sent.groupBy("kind", "bucket")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    ends = table.filter(~held).count()
    sums = by_bucket.applyInArrow(_summarise(depth), _SUMMARY_DDL).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")])
    found = sums.orderBy("kind", "key").toPandas()
    words, nodes = found[found.kind == _WORDS], found[found.kind == _GRAMS]
    tokens, distinct = int(words.zeros.sum()) + ends, int(words.ones.sum()) + int(ends > 0)
    top = spark.sparkContext.broadcast(Top(nodes.key.to_numpy().astype(np.uint64), nodes.zeros.to_numpy(), nodes.ones.to_numpy(), nodes.log_w.to_numpy()))
    told = by_bucket.applyInArrow(_answer(depth, top), _BLOBS_DDL)
    return by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_score(depth, modulus, remainder, tokens, distinct, ends), _RESULT_DDL)
