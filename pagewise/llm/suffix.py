"""Suffix-array dedup by deep-shallow sorting: removes each byte covered by a SPAN-byte string that
also starts earlier.

Sorting every suffix of a corpus would move each byte many times, and only suffixes that agree for
SPAN bytes with another one matter. Each window of SPAN bytes has an anchor: the K-byte gram in it
with the least hash, the leftmost such. Equal windows have equal anchors at equal offsets. So

1. each chunk of documents sends the hashes of its anchors, once each, to buckets of the hash;
2. buckets tell chunks, by two bits each, which hashes other chunks have as well, and which are hot;
3. chunks send the suffixes at repeated anchors, with the bytes before them, once for each distinct
   context (later equal ones in the chunk are repeats already), to buckets;
4. buckets sort the suffixes, and the reversed prefixes, deep-shallow: multikey quicksort by 8-byte
   characters to SHALLOW bytes, then blind tries for the groups with a longer common prefix. Common
   prefix lengths give, for each offset of the anchor in a window, the groups of equal windows; all
   but the first of a group, by document and start, are repeats. A bucket sorts the contexts of some
   anchors at a time. An anchor with more than HOT contexts isn't sorted in one place: each of its
   windows goes by a 128-bit hash of its own, which gives the same groups;
5. chunks cut the bytes that repeats cover.

Chunks, not rows, are shuffled, as packed arrays; a chunk sends each string once, so frequent ones
come as often as there are chunks.

Order: by doc_id, null last, and start. Edge cases: a null text is empty; matches never cross
documents; texts under SPAN bytes stay whole; rows with equal doc_id share a chunk and are taken
one after the other; rows without one are taken in order of a hash of their text; of rows equal in
both one counts as earlier; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, byte_texts, chunked, dropped, mixed, pack, pack_keys, stored, unpack, unpack_keys

SPAN, K = 100, 24
OFFSETS = SPAN - K + 1  # places of an anchor in a window, 0 to OFFSETS - 1
SHALLOW = 32
CHUNK_BYTES = 24 << 20
#: Windows of a chunk, and contexts of a chunk or bucket, that are worked on at a time.
SLICE, PIECE = 1 << 18, 1 << 14
#: Buckets a chunk: several, so that those that share a task even out.
BUCKETS = 4
#: Distinct contexts up to which an anchor's are sorted together; those of a hotter one are spread by window.
HOT = 1 << 15
_BYTE = np.random.default_rng(9).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)


# ---------------------------------------------------------------- deep-shallow sorting


def blind_trie_order(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length: a trie that keeps only branching places and bytes."""
    numbers = [int.from_bytes(s, "big") for s in strings]
    bits = 8 * len(strings[0])
    root: int | list = 0  # a leaf is a string's index, an inner node [place, {byte: child}]
    for new in range(1, len(strings)):
        s, node = strings[new], root
        while isinstance(node, list):  # descend blindly to any leaf below
            node = node[1].get(s[node[0]]) if s[node[0]] in node[1] else next(iter(node[1].values()))
        place = (bits - (numbers[new] ^ numbers[node]).bit_length()) // 8  # first byte that differs
        old, parent, node = strings[node][place], None, root
        while isinstance(node, list) and node[0] < place:
            parent, node = node, node[1][s[node[0]]]
        if isinstance(node, list) and node[0] == place:
            node[1][s[place]] = new
            continue
        branch = [place, {old: node, s[place]: new}]
        if parent is None:
            root = branch
        else:
            parent[1][s[parent[0]]] = branch
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out.append(node)
    return out


def multikey_quicksort(chars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their first `depth` characters, and by place in it the number of the
    range of equal ones.

    Ternary partitions about a pivot of each range, the median of three of its characters; all ranges
    of a round are split at once. Ranges equal to the pivot go on with the next character.
    """
    n = len(chars)
    order, at = np.arange(n), np.zeros(n, np.int64)  # at: the character by which a place's range is split next
    head = np.zeros(n, bool)
    head[:1] = True
    live = np.arange(n if depth and n > 1 else 0)
    while len(live):
        rows = order[live]
        c = chars[rows, at[live]]
        lo = np.flatnonzero(head[live])
        size = np.diff(np.append(lo, len(live)))
        x, y, z = c[lo], c[lo + size // 2], c[lo + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        side = 1 + (c > pivot).astype(np.int64) - (c < pivot)
        part = np.repeat(np.arange(len(lo)), size) * 3 + side
        moved = np.argsort(part, kind="stable")
        part = part[moved]
        order[live] = rows[moved]
        new = np.append(True, part[1:] != part[:-1])
        head[live] = new
        at[live] += part % 3 == 1
        lo = np.flatnonzero(new)
        several = np.repeat(np.diff(np.append(lo, len(live))) > 1, np.diff(np.append(lo, len(live))))
        live = live[several & (at[live] < depth)]
    return order, np.cumsum(head)


def deep_shallow_sort(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of an n x length byte matrix, and the common prefix of each with the one
    before it in that order."""
    n, length = strings.shape
    padded = np.zeros((n, -(-length // 8) * 8), np.uint8)
    padded[:, :length] = strings
    chars = padded.view(">u8").astype(np.uint64)
    order, of = multikey_quicksort(chars, min(SHALLOW // 8, chars.shape[1]))
    group = np.empty(n, np.int64)
    group[order] = of
    # the rest by blind tries, a trie for each group with rests that differ
    rest = padded[:, SHALLOW:]
    rank = np.zeros(n, np.int64)
    if rest.shape[1]:
        tail = np.zeros(n, np.uint64)
        for d in range(SHALLOW // 8, chars.shape[1]):
            tail = mixed(tail * U(31) + chars[:, d])
        order = np.lexsort((tail, group))
        g, t = group[order], tail[order]
        head = np.ones(n, bool)
        head[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
        firsts = np.flatnonzero(head)
        of_first = g[firsts]
        edges = np.flatnonzero(np.append(True, of_first[1:] != of_first[:-1]))
        ends = np.append(edges[1:], len(firsts))
        first_rank = np.zeros(len(firsts), np.int64)
        for a in np.flatnonzero(ends - edges > 1):
            lo, hi = edges[a], ends[a]
            for r, which in enumerate(blind_trie_order([x.tobytes() for x in rest[order[firsts[lo:hi]]]])):
                first_rank[lo + which] = r
        rank[order] = first_rank[np.cumsum(head) - 1]
        order = np.lexsort((rank, group))
    s = strings[order]
    common = np.zeros(n, np.int64)
    if n > 1:
        differs = s[1:] != s[:-1]
        common[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), length)
    return order, common


# ---------------------------------------------------------------- chunks


class Chunk:
    """The documents of a chunk, in order, as one byte array."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_id").to_pylist()
        texts = [t or b"" for t in byte_texts(table.column("text"))]
        late, key = order_keys(self.ids, texts)
        order = np.lexsort((key, late))
        self.late, self.key = late[order], key[order]
        self.ids, self.texts = [self.ids[i] for i in order], [texts[i] for i in order]
        self.sizes = np.array([len(t) for t in self.texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """place, hash, and least and most offset in the windows it anchors, of each anchor by place.

        Works through slices of windows, so that what it holds beside its result is bounded.
        """
        parts = [self._slice_anchors(at, min(SLICE, len(self.data) - SPAN + 1 - at)) for at in range(0, len(self.data) - SPAN + 1, SLICE)]
        place, h, first, last = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(4))
        new = np.append(True, place[1:] != place[:-1]) if len(place) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(place))[: len(heads)] - 1
        return place[heads], h[heads].astype(np.uint64), place[heads] - last[tails], place[heads] - first[heads]

    def _slice_anchors(self, lo: int, n: int) -> tuple[np.ndarray, ...]:
        """place, hash, first and last window of the anchors of the windows that start at lo to lo + n - 1."""
        h, width = _BYTE[self.data[lo : lo + n + SPAN - 1]], 1
        for bit in (8, 16):  # 8 bytes, then 16, then 24 of 8 and 16
            while width < bit:
                h = mixed(h[: len(h) - width] * U(0x9E3779B97F4A7C15) + h[width:])
                width *= 2
            if bit == 8:
                eight = h
        grams = n + SPAN - K
        h = mixed(h[:grams] * U(0xD6E8FEB86659FD93) + eight[16 : 16 + grams])
        m = (h >> U(32) << U(32)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= OFFSETS:
            m = np.minimum(m[: len(m) - width], m[width:])
            width *= 2
        extra = OFFSETS - width
        m = np.minimum(m[: len(m) - extra], m[extra:])
        inside = np.ones(n, bool)  # windows within one document
        doc, end = np.searchsorted(self.ends, [lo, lo + n], "right").tolist()
        for b in self.ends[doc : end + 1].tolist():
            inside[max(0, b - SPAN + 1 - lo) : max(0, b - lo)] = False
        at = np.flatnonzero(inside)
        place = (m[at] & U(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else place
        tails = np.append(heads[1:], len(at))[: len(heads)] - 1
        # anchors are those of least hash: mixed once more, so that buckets of the hash are even
        return place[heads] + lo, mixed(h[place[heads]]), at[heads] + lo, at[tails] + lo

    def contexts(self, place: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Bytes around each anchor: OFFSETS - 1 before it, 0 where its windows don't reach, and SPAN from it."""
        at = place[:, None] + np.arange(1 - OFFSETS, SPAN)
        out = self.data[np.clip(at, 0, len(self.data) - 1)]
        out[at >= len(self.data)] = 0
        out[:, : OFFSETS - 1][np.arange(OFFSETS - 1, 0, -1) > most[:, None]] = 0
        return out

    def context_prints(self, place: np.ndarray, h: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """A hash of each anchor's context and offsets."""
        out = h + least.astype(np.uint64) * U(977) + most.astype(np.uint64) * U(131071)
        for lo in range(0, len(place), PIECE):
            around = self.contexts(place[lo : lo + PIECE], most[lo : lo + PIECE])
            padded = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
            padded[:, : around.shape[1]] = around
            for c in padded.view(np.uint64).T:
                out[lo : lo + PIECE] = mixed(out[lo : lo + PIECE] * U(31) + c)
        return out

    def window_prints(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window, as two arrays."""
        out = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
        eights = np.lib.stride_tricks.sliding_window_view(self.data, 8)
        for lo in range(0, len(start), PIECE):
            at = start[lo : lo + PIECE]
            for k in [*range(0, SPAN - 8, 8), SPAN - 8]:
                c = np.ascontiguousarray(eights[at + k]).view(np.uint64).reshape(-1)
                for x, by in zip(out, (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)), strict=True):
                    x[lo : lo + PIECE] = mixed(x[lo : lo + PIECE] * by + mixed(c ^ by))
        return out


def order_keys(ids: list[int | None], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """By document: whether it has no doc_id, and the doc_id or else a hash of the text. Of rows with
    one doc_id those later in the chunk count as later."""
    late = np.array([i is None for i in ids], np.uint8)
    key = np.array([xxhash.xxh3_64_intdigest(t) >> 1 if i is None else i for i, t in zip(ids, texts, strict=True)], np.int64)
    return late, key


def _split(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted 64-bit keys dealt by their upper part."""
    edges = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(buckets)], np.uint64))
    edges = np.append(edges, len(keys))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_BLOBS = (["key", "chunk", "blob"], [pa.int32(), pa.int32(), pa.binary()])
_BLOBS_DDL = "key int, chunk int, blob binary"
_KINDS = (["kind", "key", "chunk", "blob"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])
_KINDS_DDL = f"kind int, {_BLOBS_DDL}"
#: Kinds of rows: contexts to be sorted, spans of a chunk that are repeats already, windows of hot anchors.
_CONTEXTS, _SPANS, _WINDOWS = 0, 1, 2
_META = (np.uint8, np.int64, np.int32, np.int64, np.uint8, np.uint8)
_PRINTS = (np.uint64, np.uint8, np.int64, np.int32, np.int64)


def _send_hashes(buckets: int):
    """To each bucket: the chunk's anchor hashes, and how many distinct contexts it has of each."""

    def fn(table: pa.Table) -> pa.Table:
        number, chunk = table.column("chunk")[0].as_py(), Chunk(table)
        place, h, least, most = chunk.anchors()
        keys, which, n = np.unique(h, return_inverse=True, return_counts=True)
        again = n[which] > 1
        if again.any():
            prints = chunk.context_prints(place[again], h[again], least[again], most[again])
            _, first = np.unique(prints, return_index=True)
            n = np.where(n > 1, np.bincount(which[again][first], minlength=len(keys)), 1)
        return _table([(b, number, pack_keys(keys[lo:hi], n[lo:hi].astype(np.uint32))) for b, lo, hi in _split(keys, buckets)], *_BLOBS)

    return fn


def _find_repeated(hot: int):
    """To each chunk, two bits for each of its hashes: other chunks have it too; it has over `hot` contexts in all."""

    def fn(table: pa.Table) -> pa.Table:
        bucket = table.column("key")[0].as_py()
        lists = [unpack_keys(b, np.uint32) for b in table.column("blob").to_pylist()]
        every = np.concatenate([x[0] for x in lists])
        keys, which, n = np.unique(every, return_inverse=True, return_counts=True)
        contexts = np.bincount(which, np.concatenate([x[1] for x in lists]), len(keys))
        rows = []
        for chunk, (mine, _) in zip(table.column("chunk").to_pylist(), lists, strict=True):
            at = np.searchsorted(keys, mine)
            rows.append((bucket, chunk, np.packbits(np.concatenate([n[at] > 1, contexts[at] > hot])).tobytes()))
        return _table(rows, *_BLOBS)

    return fn


def _send_contexts(buckets: int):
    def fn(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _table([], *_KINDS)
        number, chunk = docs.column("chunk")[0].as_py(), Chunk(docs)
        place, h, least, most = chunk.anchors()
        keys, which, n = np.unique(h, return_inverse=True, return_counts=True)
        repeated, hot = n > 1, np.zeros(len(keys), bool)
        bits = dict(zip(told.column("key").to_pylist(), told.column("blob").to_pylist(), strict=True))
        for b, lo, hi in _split(keys, buckets):
            mine = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=2 * (hi - lo)).view(bool)
            repeated[lo:hi] |= mine[: hi - lo]
            hot[lo:hi] = mine[hi - lo :]
        rows = []
        is_hot = hot[which]
        if is_hot.any():
            rows += _hot_windows(chunk, number, place[is_hot], least[is_hot], most[is_hot], buckets)
        mine = repeated[which] & ~is_hot
        place, h, least, most = place[mine], h[mine], least[mine], most[mine]
        # the first of equal contexts goes out; later ones repeat it, whatever it turns out to be
        _, first, of = np.unique(chunk.context_prints(place, h, least, most), return_index=True, return_inverse=True)
        first = first[of]
        same = (first != np.arange(len(place))) & (least == least[first]) & (most == most[first])
        for lo in range(0, len(place), PIECE):
            at = np.flatnonzero(same[lo : lo + PIECE]) + lo
            same[at] = (chunk.contexts(place[at], most[at]) == chunk.contexts(place[first[at]], most[at])).all(axis=1)
        if same.any():
            rows.append((_SPANS, number, number, pack((place - most)[same], (place - least)[same])))
        send = np.flatnonzero(~same)
        send = send[np.argsort(h[send], kind="stable")]
        for b, lo, hi in _split(h[send], buckets):
            s = send[lo:hi]
            doc = np.searchsorted(chunk.ends, place[s], "right")
            meta = pack_keys(h[s], chunk.late[doc], chunk.key[doc], doc.astype(np.int32), place[s] - chunk.starts[doc], least[s].astype(np.uint8), most[s].astype(np.uint8))
            rows.append((_CONTEXTS, b, number, len(meta).to_bytes(4, "big") + meta + zlib.compress(chunk.contexts(place[s], most[s]).tobytes(), 1)))
        return _table(rows, *_KINDS)

    return fn


def _hot_windows(chunk: Chunk, number: int, place: np.ndarray, least: np.ndarray, most: np.ndarray, buckets: int) -> list[tuple]:
    """The windows of anchors with too many contexts to be sorted together: each by a hash of its own,
    so that they spread over all buckets. A chunk sends each distinct window once."""
    n = most - least + 1
    start = np.repeat(place - most, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a, b = chunk.window_prints(start)
    order = np.lexsort((start, b, a))
    a, b, start = a[order], b[order], start[order]
    again = np.append(False, (a[1:] == a[:-1]) & (b[1:] == b[:-1]))
    rows = [(_SPANS, number, number, pack(start[again], start[again]))] if again.any() else []
    a, b, start = a[~again], b[~again], start[~again]
    doc = np.searchsorted(chunk.ends, start, "right")
    for bucket, lo, hi in _split(a, buckets):
        d = doc[lo:hi]
        rows.append((_WINDOWS, bucket, number, pack_keys(a[lo:hi], b[lo:hi], chunk.late[d], chunk.key[d], d.astype(np.int32), start[lo:hi] - chunk.starts[d])))
    return rows


def repeated_windows(least: np.ndarray, most: np.ndarray, around: np.ndarray) -> np.ndarray:
    """n x OFFSETS: whether the window that has the anchor at this offset repeats an earlier one.
    Rows are in order of document and start."""
    n = len(least)
    by_right, right = deep_shallow_sort(around[:, OFFSETS - 1 :])
    by_left, left = deep_shallow_sort(np.ascontiguousarray(around[:, OFFSETS - 2 :: -1]))
    out = np.zeros((n, OFFSETS), bool)
    right_group, left_group = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for offset in range(OFFSETS):
        at = np.flatnonzero((least <= offset) & (offset <= most))
        if len(at) < 2:
            continue
        right_group[by_right] = np.cumsum(right < SPAN - offset)
        left_group[by_left] = np.cumsum(left < offset)
        both = right_group[at] * (n + 1) + left_group[at]
        _, first = np.unique(both, return_index=True)
        again = np.ones(len(at), bool)
        again[first] = False
        out[at[again], offset] = True
    return out


def _find_windows(table: pa.Table) -> pa.Table:
    """Sorts a bucket's contexts, some anchors at a time, and tells chunks the runs of repeated windows."""
    blobs = table.column("blob")
    head = lambda k: int.from_bytes(blobs[k].as_buffer()[:4].to_pybytes(), "big")
    metas = [unpack_keys(blobs[k].as_buffer()[4 : 4 + head(k)].to_pybytes(), *_META) for k in range(table.num_rows)]
    sizes = [len(m[0]) for m in metas]
    chunks = np.repeat(np.array(table.column("chunk").to_pylist(), np.int32), sizes)
    h, late, key, docs, starts, least, most = (np.concatenate(x) for x in zip(*metas, strict=True))
    around, at = np.empty((len(h), OFFSETS - 1 + SPAN), np.uint8), 0
    for k, n in enumerate(sizes):  # unpacked one by one into place
        around[at : at + n] = np.frombuffer(zlib.decompress(blobs[k].as_buffer()[4 + head(k) :]), np.uint8).reshape(n, -1)
        at += n
    order = np.lexsort((starts, docs, key, late, h))
    ends = np.flatnonzero(np.append(np.diff(h[order]) != 0, True)) + 1  # of each anchor's contexts
    spans, lo = [], 0
    while lo < len(order):
        hi = int(ends[min(np.searchsorted(ends, lo + PIECE, "right"), len(ends) - 1)])
        some, lo = order[lo:hi], hi
        some = some[np.lexsort((starts[some], docs[some], key[some], late[some]))]
        again = repeated_windows(least[some], most[some], around[some])
        # runs of offsets; the window at offset i starts i before the anchor
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        row = some[row]
        spans.append((chunks[row], docs[row], starts[row] - last + 1, starts[row] - first))
    return _to_chunks(*(np.concatenate(x) for x in zip(*spans, strict=True)))


def _find_hot(table: pa.Table) -> pa.Table:
    """Of each distinct window of hot anchors all but the first are repeats."""
    parts = [unpack_keys(x, *_PRINTS) for x in table.column("blob").to_pylist()]
    chunks = np.repeat(np.array(table.column("chunk").to_pylist(), np.int32), [len(x[0]) for x in parts])
    a, b, late, key, docs, starts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((starts, docs, key, late, b, a))
    again = order[1:][(np.diff(a[order]) == 0) & (np.diff(b[order]) == 0)]
    return _to_chunks(chunks[again], docs[again], starts[again], starts[again])


def _to_chunks(chunks: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
    order = np.argsort(chunks, kind="stable")
    found, at = np.unique(chunks[order], return_index=True)
    rows = [(0, int(c), pack(docs[s], first[s], last[s])) for c, s in zip(found, np.split(order, at[1:]), strict=False) if len(s)]
    return _table(rows, *_BLOBS)


_RESULT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "kept": pa.binary()}


def _covered(spans: list[list[np.ndarray]], n: int) -> np.ndarray:
    """The bytes of n that some window from a span's first to its last start covers."""
    edge = np.zeros(n + 1, np.int8)
    if spans:
        lo, hi = (np.concatenate(x) for x in zip(*spans, strict=True))
        order = np.argsort(lo, kind="stable")
        lo, end = lo[order], np.maximum.accumulate(hi[order] + SPAN)
        new = np.append(True, lo[1:] > end[:-1])
        edge[lo[new]] = 1
        edge[end[np.append(new[1:], True)]] = -1
    return np.cumsum(edge[:-1], dtype=np.int8).view(bool)


def _cut(keep_bytes: bool):
    def fn(docs: pa.Table, told: pa.Table) -> pa.Table:
        names = [*_RESULT][: 6 if keep_bytes else 5]
        types = [_RESULT[x] for x in names]
        if not docs.num_rows:
            return _table([], names, types)
        chunk, spans = Chunk(docs), []
        for kind, blob in zip(told.column("kind").to_pylist(), told.column("blob").to_pylist(), strict=True):
            if kind == _SPANS:
                spans.append(unpack(blob, np.int64, np.int64))
            else:
                doc, lo, hi = unpack(blob, np.int32, np.int64, np.int64)
                spans.append([lo + chunk.starts[doc], hi + chunk.starts[doc]])
        gone = _covered(spans, len(chunk.data))
        rows = []
        for i, (a, b) in enumerate(zip(chunk.starts.tolist(), chunk.ends.tolist(), strict=True)):
            mine = gone[a:b]
            n = int(mine.sum())
            kept = chunk.data[a:b][~mine].tobytes() if n else chunk.texts[i]
            spans = int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()) if n else 0
            rows.append((chunk.ids[i], b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept)[: len(names)])
        return _table(rows, names, types)

    return fn


def remove_repeats(spark: SparkSession, docs: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, keep_bytes: bool = False, hot: int = HOT) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if asked the kept bytes."""
    table, n = chunked(spark, docs, chunk_bytes)
    by_chunk, buckets = table.groupBy("chunk"), n * BUCKETS
    sent = stored(spark, by_chunk.applyInArrow(_send_hashes(buckets), _BLOBS_DDL), "hashes")
    told = stored(spark, sent.groupBy("key").applyInArrow(_find_repeated(hot), _BLOBS_DDL), "repeated")
    found = stored(spark, by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(_send_contexts(buckets), _KINDS_DDL), "contexts")
    windows = found.filter(F.col("kind") == _CONTEXTS).groupBy("key").applyInArrow(_find_windows, _BLOBS_DDL)
    windows = windows.unionByName(found.filter(F.col("kind") == _WINDOWS).groupBy("key").applyInArrow(_find_hot, _BLOBS_DDL))
    known = found.filter(F.col("kind") == _SPANS).select("kind", "chunk", "blob")
    spans = stored(spark, windows.select(F.lit(_CONTEXTS).alias("kind"), "chunk", "blob").unionByName(known), "windows")
    dropped(spark, sent, told, found)
    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return by_chunk.cogroup(spans.groupBy("chunk")).applyInArrow(_cut(keep_bytes), ddl)
