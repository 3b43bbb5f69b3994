"""Kernels of the training-data operators that need no Spark session."""

import random

import numpy as np
import pyarrow as pa
import pytest

from pagewise.llm import common, neardup, suffix


@pytest.mark.parametrize("tail", [b"", b" ", b"q" * 600_000 + b" z", b"\n" + b"q" * 300_000])
def test_lower_word_hashes(tail):
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcXYZ\xc3\xa9\x1c\x85\x00") for _ in range(rng.randint(1, 4))) for _ in range(60_000)]
    raw = b"".join(w + rng.choice([b" ", b"\n\t", b"\x0b\x0c", b"\r"]) for w in words) + tail
    got, want, of = common.lower_word_hashes(raw).tolist(), raw.lower().split(), {}
    assert len(got) == len(want)
    assert all(of.setdefault(w, h) == h for w, h in zip(want, got, strict=True))
    assert len(set(of.values())) == len(of)


def test_lower_word_hashes_of_nothing():
    assert len(common.lower_word_hashes(b"")) == len(common.lower_word_hashes(b" \n")) == 0


def test_words_that_a_polynomial_hash_confuses():
    """Thue-Morse words and their complements collide in any polynomial hash modulo 2^64."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    texts = [b" ".join(bytes(97 + (b ^ flip) for b in bits) for _ in range(5)) for flip in (0, 1)]
    a, b = (common.shingle_set(common.lower_word_hashes(t)).tolist() for t in texts)
    assert a != b


@pytest.mark.parametrize("depth", [0, 1, 4])
def test_multikey_quicksort(depth):
    rng = np.random.default_rng(depth)
    for n in (0, 1, 2, 700):
        chars = rng.integers(0, 3, (n, 5)).astype(np.uint64)
        order, group = suffix.multikey_quicksort(chars, depth)
        keys = [tuple(chars[i, :depth].tolist()) for i in order]
        assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
        assert all((a == b) == (g == h) for a, b, g, h in zip(keys, keys[1:], group.tolist(), group[1:].tolist(), strict=False))


def test_suffix_chunks_work_alike_in_slices(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choices("ab", k=rng.choice([0, 99, 100, 101, 250, 4000]))) for _ in range(12)]
    texts += [texts[3] + texts[4], "x" * 700]
    table = pa.table({"chunk": pa.array([0] * len(texts), pa.int32()), "doc_id": pa.array([*range(len(texts) - 1), None], pa.int64()), "text": texts})
    results = []
    for slice_, piece in [(1 << 18, 1 << 14), (333, 16), (101, 7)]:
        monkeypatch.setattr(suffix, "SLICE", slice_)
        monkeypatch.setattr(suffix, "PIECE", piece)
        bits = suffix._find_repeated(suffix.HOT)(suffix._send_hashes(1)(table))
        sent = suffix._send_contexts(1)(table, bits)
        spans = sent.filter(pa.array([k == suffix._SPANS for k in sent.column("kind").to_pylist()])).select(["kind", "chunk", "blob"])
        found = suffix._find_windows(sent.filter(pa.array([k == suffix._CONTEXTS for k in sent.column("kind").to_pylist()])))
        told = pa.concat_tables([spans, pa.table({"kind": pa.array([0] * found.num_rows, pa.int32()), "chunk": found.column("chunk"), "blob": found.column("blob")})])
        results.append(suffix._cut(True)(table, told).to_pylist())
    assert results[0] == results[1] == results[2] and sum(r["n_removed"] for r in results[0]) > 700


def classes(n, links, known):
    label = list(range(n))
    joins = [*links, *((i, known.index(k)) for i, k in enumerate(known))]
    for a, b in joins:
        keep, gone = sorted((label[a], label[b]))
        label = [keep if x == gone else x for x in label]
    return label


def test_spanning_links_connect_all_that_are_linked():
    rng = random.Random(1)
    for _ in range(300):
        n, base, sets = rng.randint(1, 14), rng.sample(range(60), rng.randint(3, 30)), []
        for _ in range(n):
            s = {*base, *rng.sample(range(100), rng.randint(0, 4))} if rng.random() < 0.8 else set(rng.sample(range(100), rng.randint(1, 30)))
            sets.append(s)
        known = list(range(n)) if rng.random() < 0.5 else [rng.randint(0, 4) for _ in range(n)]
        linked = {(i, j) for i in range(n) for j in range(n) if i != j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
        got = neardup.spanning_links([np.array(sorted(s), np.uint64) for s in sets], known, 85)
        assert set(got) <= linked
        assert classes(n, got, known) == classes(n, linked, known)
