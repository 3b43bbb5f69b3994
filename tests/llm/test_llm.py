"""The training-data operators against brute force, on small inputs with the awkward cases."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagewise.llm import chat, ctw, decontam, licence, linededup, mixing, neardup, quality, queries, suffix, urlfilter

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.2 else "".join(rng.choices(["th", "er", "on", "an", "re", "he"], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with nulls, empty texts, copies, near copies, one long text and repeated rows."""
    rng = random.Random(5)
    out, base = [], prose(rng, 300).split()
    for i in range(40):
        out.append((i, prose(rng, rng.choice([3, 40, 120])), "en", f"s{i % 4}", 0))
    for i in range(40, 110):  # near copies of one text
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(300)] = "x" * rng.randint(3, 9)
        out.append((i, " ".join(w), "en", "s0", 0))
    out += [(110, out[3][1].upper(), "en", None, 0), (111, None, None, None, None), (112, "", "en", "s1", 0), (113, " \n\t", "en", "s9", 0), (114, "One Two", "en", "s1", 0), (115, "one two", "en", "s1", 0), (None, out[5][1], "en", "s2", 0), (116, prose(rng, 20000), "en", "s3", 0)]
    return [*out, out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("kept", F.lit(1)).withColumn("size", F.lit("x")).withColumn("keys", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, threshold):
    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    parent, by, shared = {i: i for i in sets}, defaultdict(list), Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        for s in sets[i]:
            shared.update((j, i) for j in by[s])
            by[s].append(i)
    for (a, b), n in shared.items():
        if 100 * n >= threshold * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [384, 16])  # 16: the group of near copies takes many blocks
def test_near_dedup(spark, docs, rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    got = neardup.components(spark, docs, threshold=85).collect()
    want = brute_components(rows, 85)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(want[5], True)]
    assert {r.doc_id: r.n_shingles for r in got}[111] == 0


def test_near_dedup_branches(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(neardup, "LEAF", 2)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = {r.doc_id: r.component_id for r in neardup.components(spark, docs, threshold=85).filter("doc_id is not null").collect()}
    assert got == brute_components(rows, 85)


def test_near_dedup_branches_only_where_that_pays(spark):
    def made(n, tokens):
        rng = np.random.default_rng(8)
        sigs = rng.integers(0, tokens, (n, neardup.POSITIONS)).tolist()
        classes = spark.createDataFrame([(i.to_bytes(16, "big"), i, s) for i, s in enumerate(sigs)], "cls binary, rep long, sig array<int>")
        return neardup._nodes(spark, classes).count()

    roots = neardup.TREES * neardup.BRANCHES
    # a quarter alike, in root nodes of about 60: to branch them doubles the rows and spares few pairs
    assert made(240, 4) == roots * 240
    # in root nodes of about 750 it spares many
    assert made(3000, 4) > roots * 3000


def test_near_dedup_of_nothing(spark, none):
    assert neardup.components(spark, none).count() == 0 and neardup.deduplicated(spark, none).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark, docs, rows):
    got = Counter((r.doc_id, r.text) for r in neardup.deduplicated(spark, docs, threshold=85).select("doc_id", "text").collect())
    want = brute_components(rows, 85)
    first = {r[0]: r[1] for r in rows}
    assert got == Counter({(i, first[i]): 1 for i in want if want[i] == i})


def test_near_dedup_tells_rows_apart_by_text(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(3, a, 1), (3, b, 2), (4, a, 3), (3, b, 4), (None, c, 5), (None, c, 6), (None, None, 7), (None, None, 8), (5, "", 9), (5, "", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `_row` int")
    got = neardup.deduplicated(spark, df).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(3, a): 1, (3, b): 1, (None, c): 1, (None, None): 2, (5, ""): 2})
    assert neardup.deduplicated(spark, df).columns == df.columns


def test_mixing(spark, docs, rows, none):
    got = mixing.mix(spark, docs).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, mixing.mix(spark, docs.repartition(5)).collect()))
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").encode().split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights, cap, open_ = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, {s: 2.0 * n for s, n in sizes.items()}, set(names)
    target, budget = {}, 1.5 * sum(sizes.values())
    while open_:  # clamp and share again until none is above
        level = (budget - sum(target.values())) / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] >= cap[s]}
        if not over:
            target |= {s: level * weights[s] for s in open_}
            break
        target |= {s: cap[s] for s in over}
        open_ -= over
    for r in got:
        assert math.isclose(r.target, target[r.source], rel_tol=1e-9) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    for s, n in taken.items():  # a source misses its target by half a document that isn't large, or by what its large ones can't fill
        largest = max((r.size for r in got if r.source == s), default=0)
        assert abs(n - target[s]) <= max(largest, 0.05 * target[s])
    assert mixing.mix(spark, none).count() == 0


def test_mixing_comes_near_targets(spark):
    got = mixing.mix(spark, queries.documents(spark, "/root/testdata/sf0.01")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("largest")).collect()
    assert got and all(abs(r.taken - r.target) <= max(0.02 * r.target, r.largest) for r in got)


def test_quality(spark, docs, rows):
    got = quality.judge(spark, docs, measures=("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")).collect()
    assert len(got) == len(rows) and all(not r.kept for r in got if r.n_words < 50)
    hashes = quality.WordHashes()
    f = quality.Features("a b c\nx\na b c\né # $\n\n".encode(), hashes)
    assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == (10, 10, 2, 1, 6)
    assert {c for c in quality.filtered(spark, docs).columns} == set(docs.columns)
    assert quality.filtered(spark, docs).filter("kept = 1").count() == sum(r.kept for r in got) and "kept_given" in quality.judge(spark, docs).columns


def test_quality_order():
    order = quality.estimate(["a b c " * 30, None, "x", *(f"word{i} and other{i} " * 40 for i in range(20))])
    assert {e.rule.name for e in order} == {r.name for r in quality.RULES}
    calls = []
    cheap = quality.Rule("cheap", lambda f: bool(calls.append(0)) or f.raw != b"a")
    dear = quality.Rule("dear", lambda f: sum(range(20000)) > 0)
    assert [e.rule.name for e in quality.estimate(["a", "b", "c", "d"], (dear, cheap))] == ["cheap", "dear"] and len(calls) <= 8
    assert [e.rule for e in quality.estimate([])] != []


def test_quality_of_nothing(spark, none):
    assert quality.judge(spark, none, measures=("n_words",)).count() == 0


def test_ctw_against_recursion(spark):
    rows = [(i, t) for i, t in enumerate(["the cat", "then the hat", "", "éa the the", None, "zq", "abcabcabc"])] + [(None, "the")]
    got = {r.doc_id: r for r in ctw.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string"), depth=3, chunk_bytes=8).collect()}
    counts, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2

    def decisions(text):
        s = b"\0" * 3 + (text or "").encode() + b"\xff"
        for p in range(3, len(s)):
            for b in range(8):
                yield s[p - 3 : p][::-1], (1 << b) | (s[p] >> (8 - b)), (s[p] >> (7 - b)) & 1

    for i, t in rows:
        for c, z, bit in () if held(i) else decisions(t):
            for d in range(4):
                counts[c[:d], z][bit] += 1
                if d:
                    kids[c[: d - 1], z].add((c[:d], z))

    def log_e(k):
        a, b = counts.get(k, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_w(k):
        return log_e(k) if len(k[0]) == 3 else np.logaddexp(log_e(k), sum(log_w(x) for x in kids.get(k, ()))) - math.log(2)

    def one(c, z, d=0):
        k = c[:d], z
        a, b = counts.get(k, (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if d == 3:
            return kt
        stop = 0.5 * math.exp(log_e(k) - log_w(k))
        return stop * kt + (1 - stop) * one(c, z, d + 1)

    for i, t in rows:
        want = sum(math.log10(p if bit else 1 - p) for c, z, bit in decisions(t) for p in [one(c, z)])
        assert math.isclose(got[i].score, want, rel_tol=1e-5) and got[i].held_out == held(i)
    words = lambda t: [*(t or "").lower().split(), None]
    known = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, distinct = sum(known.values()), len(known)
    for i, t in rows:
        r, ws = got[i], words(t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in known for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((known[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)


def test_ctw_of_nothing(spark, none):
    assert ctw.score_texts(spark, none.withColumn("chunk", F.lit(1)).withColumn("kind", F.lit(1))).count() == 0


def test_ctw_predicts_held_out_text(spark):
    got = ctw.score_texts(spark, queries.documents(spark, SF)).toPandas()
    assert got[got.held_out].bits_per_byte.mean() < 4 and (got.base_score < 0).all()


@pytest.mark.parametrize("literal", [urlfilter.LITERAL_BITS, 0])  # 0: every level is a table of blocks
@pytest.mark.parametrize("listed", [[], ["com/"], [f"k{i}.com/" for i in range(9000)]])
def test_bloom_cascade_is_exact(spark, monkeypatch, listed, literal):
    monkeypatch.setattr(urlfilter, "LITERAL_BITS", literal)
    universe = listed + [f"u{i}.org/" for i in range(20000)]
    keys = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string")
    cascade = urlfilter.build_cascade(spark, keys(listed), keys(universe))
    assert {r[0] for r in urlfilter.listed_among(keys(universe), cascade).collect()} == set(listed)
    if literal:
        assert {r[0] for r in keys(universe).filter(urlfilter.is_listed(F.col("key"), cascade)).collect()} == set(listed)


def test_bloom_cascade_of_many_keys(spark):
    listed = spark.range(500_000).select(F.concat(F.lit("k"), "id", F.lit(".com/")).alias("key"))
    universe = listed.unionByName(spark.range(700_000).select(F.concat(F.lit("u"), "id", F.lit(".org/")).alias("key")))
    cascade = urlfilter.build_cascade(spark, listed, universe)
    found = universe.filter(urlfilter.is_listed(F.col("key"), cascade))
    assert found.count() == 500_000 and found.join(listed, "key").count() == 500_000


@pytest.mark.parametrize("literal", [urlfilter.LITERAL_BITS, 0])
def test_url_filter(spark, monkeypatch, literal):
    monkeypatch.setattr(urlfilter, "LITERAL_BITS", literal)
    urls = ["https://www.example.com/en/1", "http://EXAMPLE.com/en/2#x", "https://a.example.com/de/?q=/en/", "http://x.net/es/1", "x.net/es/", None, "https://com", "http://org/", "https://notnet/es/"]
    df = spark.createDataFrame([(*r, "mine", "b") for r in enumerate(urls)], "page_id long, url string, host string, _best string")
    want = ["allow www.example.com/en/", "block example.com/en/", "allow com/", "block net/es/", "allow None", "allow None", "allow None", "allow None", "allow None"]
    got = urlfilter.judge_urls(spark, df, queries.RULES)
    assert [f"{r.verdict} {r.rule}" for r in got.orderBy("page_id").collect()] == want
    assert {(r.host_given, r._best) for r in got.collect()} == {("mine", "b")}
    assert urlfilter.judge_urls(spark, df, []).filter("rule is not null").count() == 0
    assert urlfilter.judge_urls(spark, df.limit(0), queries.RULES).count() == 0


WRAPPED = """Some words.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

More words."""


@pytest.fixture(scope="module")
def licence_model(spark, docs):
    return licence.train(spark, docs.select("doc_id", "text"))


def test_licences(spark, rows, docs, licence_model):
    more = [(900 + k, f"Some words.\n\n{notices[0]}\n\nMore words.", "en", "s", 0) for k, notices in enumerate(licence.TEMPLATES.values())] + [(950, WRAPPED, "en", "s", 0), (951, "Terms of this proprietary product forbid any copying.\n" + "word " * 200_000, "en", "s", 0)]
    found = licence.scan(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, DDL)), licence_model).collect()
    got = {r.doc_id: (r.family, r.paragraph, r.n_lines, r.confirmed) for r in found}
    assert got == {900 + k: (f, 2, 1, True) for k, f in enumerate(licence.TEMPLATES)} | {950: ("mit", 2, 6, True)} and len(got) == len(found)


def test_licences_against_a_dense_model(spark, licence_model):
    """The screen and the sparse join give what scoring every line by every weight gives."""
    rng, words = random.Random(11), sorted({w for ns in licence.TEMPLATES.values() for n in ns for w in n.split()}) + ["lorem", "ipsum"] * 20
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(120)] + [n for ns in licence.TEMPLATES.values() for n in ns] + ["", None]
    got = {r.doc_id: r for r in licence.classify(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), licence_model).collect()}
    split = lambda t: [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()]
    for i, text in enumerate(texts):
        ws = split(text)
        terms = {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}
        z = np.array(licence_model.bias) + sum((np.array(licence_model.weights[t]) for t in terms if t in licence_model.weights), np.zeros(len(licence_model.families)))
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if z.argmax() == len(z) - 1 or p.max() < licence_model.least or not any(t in licence_model.weights for t in terms):
            assert i not in got
        else:
            family = licence_model.families[z.argmax()]
            pairs_of = lambda t: {*zip(split(t), split(t)[1:], strict=False)}
            alike = max(len(pairs_of(n) & pairs_of(text)) / len(pairs_of(n)) for n in licence.TEMPLATES[family])
            assert got[i].family == family and math.isclose(got[i].probability, p.max(), rel_tol=1e-6) and math.isclose(got[i].similarity, alike, rel_tol=1e-9)


def test_licences_bear_clashing_columns(spark, licence_model):
    names = ("row", "paragraph", "n_lines", "line", "family", "probability", "h", "words", "_z", "of")
    df = spark.createDataFrame([(1, "Released under the MIT License."), (None, None), (2, ""), (2, ""), (None, "Released under the MIT License.")], "doc_id long, text string").withColumns({n: F.lit("x") for n in names})
    assert sorted((r.doc_id or 0, r.family, r.paragraph) for r in licence.classify(spark, df, licence_model).collect()) == [(0, "mit", 0), (1, "mit", 0)]


def test_licences_of_nothing(spark, none, licence_model):
    assert licence.scan(spark, none).count() == 0 and licence.scan(spark, none, licence_model).count() == 0


def test_decontamination(spark, none):
    rng = random.Random(2)
    item = prose(rng, 40).split()
    short, broken = "One tiny item", [*item[:20], "x", *item[21:]]
    docs = spark.createDataFrame([(1, prose(rng, 9000) + " " + " ".join(item).upper() + "\n" + prose(rng, 9000)), (2, "so one tiny ITEM here"), (3, " ".join(broken)), (4, " ".join(item[:30])), (5, None), (6, ""), (None, " ".join(item))], "doc_id long, text string")
    items = spark.createDataFrame([(10, " ".join(item)), (11, short), (12, None), (13, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_item_shingles, r.n_shared) for r in decontam.contaminated(spark, docs, items).collect()}
    assert got == {(1, 10): (36, 36), (2, 11): (1, 1), (3, 10): (36, 31), (None, 10): (36, 36)}
    assert sorted(r.doc_id for r in decontam.decontaminated(spark, docs, items).collect()) == [4, 5, 6]
    assert decontam.contaminated(spark, none, items).count() == 0 and decontam.contaminated(spark, docs, items.limit(0)).count() == 0


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Repeated rows, clashing columns, several blocks of items."""
    monkeypatch.setattr(decontam, "BLOCK_SHINGLES", 40)
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(30)]
    items = [(k // 2, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 8, 30])))) for k in range(40)]
    docs = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        kept = rng.choice(items)[1].split()
        if rng.random() < 0.7:
            words[3:3] = kept[: max(1, len(kept) - rng.randint(0, 4))]
        docs.append((k // 3, " ".join(words).upper()))
    want = Counter()
    for i, t in docs:
        w = t.lower().split()
        for q, x in items:
            n = min(5, len(x.split()))
            grams = lambda ws, n=n: {tuple(ws[p : p + n]) for p in range(len(ws) - n + 1)}
            shared = len(grams(w) & grams(x.split()))
            if 100 * shared >= 80 * len(grams(x.split())):
                want[i, q, len(grams(x.split())), shared] += 1
    clash = {c: F.lit("x") for c in ("n_shared", "_row", "shingles")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clash)
    b = spark.createDataFrame(items, "item_id long, text string").withColumns(clash)
    assert Counter(tuple(r) for r in decontam.contaminated(spark, d, b).collect()) == want and sum(want.values()) > 20
    left = decontam.decontaminated(spark, d, b)
    bad = {r[0] for r in want}
    assert left.columns == d.columns and {i for i, _ in docs} - bad <= {r.doc_id for r in left.collect()}


def test_chat_round_trip():
    rng = random.Random(4)
    for _ in range(300):
        turns = [("".join(rng.choices("ab<>\\\n\r g", k=3)) if rng.random() < 0.3 else "assistant", "".join(rng.choices(["\\", "<turn", "</turn>", "###", "\n", "é", "<turn assistant>\n", "x"], k=rng.randint(0, 9)))) for _ in range(rng.randint(0, 4))]
        text, mask = chat.format_turns(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescaped(text[a:b]) for a, b in mask] == [t for r, t in turns if r == "assistant"]


def test_chat_layouts(spark):
    records = [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 7}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"prompt": "q", "completion": "a", "meta": {"x": [1]}}, {"foo": 1}]
    df = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(6, "{"), (7, None), (8, '{"messages": []}')], "id int, record string")
    got = {r.id: r for r in chat.format_records(df).collect()}
    assert {got[k].formatted for k in range(5)} == {"<turn user>\nq\n</turn>\n<turn assistant>\na\n</turn>\n"}
    assert [got[k].error for k in (5, 6, 7, 8)] == ["no mapping", "not JSON", "not an object", None] and got[8].formatted == ""


HOSTILE = [
    ({"messages[].role": "user", "messages[].content": "x"}, "no mapping"),
    ({"messages": [{"role": "user", "content": "\ud800"}]}, "half of a surrogate pair"),
    ({"\ud800": 1}, "no mapping"),
    ({"messages": [{"role": "user", "content": "q"}, {"role": "user"}]}, "a turn lacks its role or text"),
    ({"messages": [{"role": "user", "content": "q"}, 5]}, "turns are no objects"),
    ({"messages": {"role": "user", "content": "q"}}, "no mapping"),
]


def test_chat_bears_any_record(spark):
    raws = [json.dumps(r) for r, _ in HOSTILE] + ['{"a":' * 5000 + "1" + "}" * 5000, "[" * 100_000, "9" * 5000, "{", None, ""]
    errors = [e for _, e in HOSTILE] + ["nested too deeply", "nested too deeply", "not JSON", "not JSON", "not an object", "not an object"]
    df = spark.createDataFrame([(k, r, "mine") for k, r in enumerate(raws)], "conv_id long, record string, error string")
    formatted = chat.format_records(df)
    got = {r.conv_id: r for r in formatted.collect()}
    assert [got[k].error for k in range(len(raws))] == errors and {r.error_given for r in got.values()} == {"mine"}
    assert all(r.formatted is None for r in got.values())
    digests = chat.digests(formatted).collect()
    assert len(digests) == len(raws) and all(r.n_turns is None and r.turns_sha256 is None for r in digests)
    assert chat.format_records(df.limit(0)).count() == 0 and chat.digests(formatted.limit(0)).count() == 0


def test_chat_carries_what_a_mapping_leaves(spark):
    records = [{"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None, "tool_calls": [1]}], "id": 7}, {"messages": [], "system": "s"}, {"a.b": 1, "prompt": "q", "completion": "a"}]
    got = [chat._format_one(json.dumps(r)) for r in records]
    assert chat.read_back(got[0][2]) == [("system", "s"), ("user", "q"), ("assistant", "")]
    assert [g[4] and json.loads(g[4]) for g in got] == [{"id": 7, "messages": [{}, {"tool_calls": [1]}]}, None, {"a.b": 1}]
    assert chat.read_back(got[1][2]) == [("system", "s")]


def test_chat_rows_with_nulls(spark):
    rows = [(None, 0, "user", "a"), (None, None, "assistant", "b"), (1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x")]
    df = chat.message_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit(1)))
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_records(df).collect()}
    assert got == {None: [("user", "a"), ("assistant", "b")], 1: [("", ""), ("user", "x"), ("user", "x")]}
    assert chat.message_records(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_deep_shallow_sort():
    rng = np.random.default_rng(3)
    m = rng.integers(0, 2, (600, 60)).astype(np.uint8)
    m[100:300, :45] = m[0, :45]
    order, common = suffix.deep_shallow_sort(m)
    s = [bytes(m[i]) for i in order]
    assert s == sorted(s)
    assert all(c == next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 60) for a, b, c in zip(s, s[1:], common[1:], strict=False))


@pytest.mark.parametrize("hot", [suffix.HOT, 2])  # 2: most repeated windows go by their own hashes
def test_suffix_dedup(spark, none, hot):
    rng = random.Random(3)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(i, base[a : a + rng.randrange(400)] + "x" * rng.randrange(250) + base[: rng.randrange(300)] + "é" * rng.randrange(80)) for i, a in enumerate(rng.choices(range(300), k=40))]
    rows += [(None, "x" * 300), (50, None), (51, ""), (52, base), (52, base), (53, "y" * 5000), (54, prose(rng, 3000) + base[:200] + prose(rng, 900))]
    seen, want = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, c in zip(b, gone, strict=True) if not c)
        want.append((i, len(b), sum(gone), sum(gone[j] > (gone[j - 1] if j else 0) for j in range(len(b))), hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "chunk": F.lit("x"), "kept": F.lit(2)})
    got = suffix.remove_repeats(spark, df, chunk_bytes=3000, hot=hot).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert suffix.remove_repeats(spark, none).count() == 0


def test_line_dedup(spark, none):
    line, long = "Read page 12 of this very old book", "w1 w2 " + " ".join("abcdefghijklmnopqr")
    rows = [(1, f"{line}\nown words of the first one\nshort line"), (2, f"{line.replace('12', '345')}\nshort line\n{line}"), (3, long), (4, long.replace(" r", " zz")), (5, long.replace(" a ", " x ").replace(" r", " zz")), (6, None), (None, line), (7, ""), (8, f"{line}x\nsame same same same same\nsame same same same same")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 3, 0) and got[2] == ("short line", 3, 2) and got[None] == ("", 1, 1)
    assert got[3][2] == 0 and got[4] == ("", 1, 1) and got[5] == ("", 1, 1)  # one segment varies
    assert got[6] == (None, 0, 0) and got[7] == ("", 1, 0) and got[8][2] == 0
    assert linededup.dedup_lines(spark, none).count() == 0


def test_line_dedup_of_short_lines(spark):
    text = "All rights reserved.\nPage {0} of 9\n{0}\n\n7 7\nSee\t{0}\n{1}"
    rows = [(k, text.format(k, "in two" if k < 3 else "word" * k)) for k in (1, 2, 3, 4)] + [(5, "12\n \nno"), (6, " \n12"), (7, "12\n \nyes\n2")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], 7, 0)
    assert [got[k] for k in (2, 3, 4)] == [("2\n\nin two", 7, 4), ("3\n\nwordwordword", 7, 4), ("4\n\nwordwordwordword", 7, 4)]  # different numbers and blank lines stay
    assert [got[k] for k in (5, 6, 7)] == [(rows[4][1], 3, 0), (" ", 2, 1), (" \nyes\n2", 4, 1)]


def test_line_dedup_of_fields_without_digits(spark):
    line, long = "Posted in {} by the staff", "Posted in the {} section on a fine day by {} of our " + "ever so busy staff here " * 2
    rows = [(k, f"{line.format(x)}\nSeen by {a} of just two") for k, (x, a) in enumerate([("News", "Ann"), ("Sport", "Bob"), ("Arts", "Bob")])]
    rows += [(3, long.format("News", "Ann")), (4, long.format("Sport", "Bob")), (5, line.format("Music").replace("staff", "editor"))]
    got = {r.doc_id: (r.text, r.n_dropped) for r in linededup.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], 0) and got[1] == ("Seen by Bob of just two", 1) and got[2] == ("", 2)
    assert got[3][1] == 0 and got[4] == ("", 1) and got[5][1] == 0  # two words in different quarters; two words of a line that isn't long


def brute_line_dedup(rows, spare_copies=False):
    """(doc_id, text) to the text left, by the templates' definition."""

    def keys(line):
        if not line.strip(" \t\x0b\x0c\r"):
            return []
        exact = line.translate(str.maketrans("\t\x0b\x0c\r", "    ")).split(" ")
        tokens = ["<*>" if re.search("[0-9]", t) else t for t in exact]
        n = len(tokens)
        if n < 5:
            return [("short", *(tokens if re.search("[^<*> ]", " ".join(tokens)) else exact))]
        if n < 16:
            edge = [2 + (n - 2) * k // 4 for k in range(5)]
            return [("plain", *tokens), *(("out", n, k, *tokens[:a], *tokens[b:]) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False)) if b > a)]
        cut = [n * k // 4 for k in range(5)]
        parts = [tuple(tokens[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
        return [("plain", *parts), *(("two", n, *tokens[:2], j, k, *(parts[i] for i in range(4) if i not in (j, k))) for j in range(4) for k in range(j + 1, 4))]

    order = lambda i: 2**63 - 1 if i is None else i
    docs, lines = defaultdict(set), defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            for k in keys(line):
                docs[k].add(order(i))
                lines[k].add(keys(line)[0])
    recurs = lambda k: len(docs[k]) > (2 if k[0] == "short" else 1) and (k[0] != "out" or len(lines[k]) >= 3)
    out = []
    for i, t in rows:
        kept, by_first = [], Counter()
        for line in (t or "").split("\n"):
            firsts = [min(docs[k]) for k in keys(line) if recurs(k)]
            if firsts:
                by_first[min(firsts)] += len(line)
            if not (firsts and min(firsts) < order(i)):
                kept.append(line)
        whole = spare_copies and by_first and 2 * max(by_first.values()) > len(t)
        out.append((i, t if t is None or whole else "\n".join(kept)))
    return out


@pytest.mark.parametrize("spare", [False, True])
def test_line_dedup_against_brute_force(spark, spare):
    rng = random.Random(21)
    words = ["Read", "more", "page", "12", "345", "a7", "of", "the", "\t", "", "news", "é"]
    pool = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 6, 16, 18]))) for _ in range(60)] + ["", " "]

    def varied(line):
        ws = line.split(" ")
        if rng.random() < 0.4:
            ws[rng.randrange(len(ws))] = rng.choice(words)
        return " ".join(ws)

    rows = [(rng.choice([None, *range(40)]) if rng.random() < 0.2 else k, "\n".join(varied(rng.choice(pool)) for _ in range(rng.randint(0, 12)))) for k in range(60)]
    rows += [(70, rows[3][1] + "\nown line of this very copy"), (71, rows[3][1]), (72, None), (73, "")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n_lines int, _id int, _gone int")
    got = linededup.dedup_lines(spark, df, spare_copies=spare)
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, brute_line_dedup(rows, spare)))
    back = linededup.deduplicated(spark, df, spare_copies=spare)
    assert back.columns == df.columns and {(r.n_lines, r._id) for r in back.collect()} == {(1, 2)}


def test_pipeline_catches_near_copies_as_near_dedup_alone(spark):
    docs = queries.documents(spark, "/root/testdata/sf0.01")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    alone = {r.doc_id: r.component_id for r in neardup.components(spark, good, threshold=80).collect()}
    cut = corpus_pipeline.line_dedup(spark, good, SF)
    left = {r[0] for r in corpus_pipeline.near_dedup(spark, cut, SF).select("doc_id").collect()}
    extra = [i for i, c in alone.items() if i != c and i in left]
    caught = sum(i != c for i, c in alone.items()) - len(extra)
    assert caught >= 0.97 * (caught + len(extra))


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_bear_odd_tables(spark, docs, none, stage):
    name, run = stage
    odd = docs.select("doc_id", "text", "lang", "source", "n_chars", "kept", F.col("size").alias("_row"), F.lit(1).alias("n_lines"), F.lit(2).alias("_gone"))
    out = run(spark, odd, SF)
    assert out.count() > 0 and (name == "mixing" or out.columns == odd.columns)
    assert run(spark, none, SF).count() == 0


def test_pipeline_against_brute_force(spark):
    """All stages but the last, each on what the one before left, by SQL and plain loops."""
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    rows = [(i, texts[i]) for i, in duck.sql(f"SELECT doc_id FROM ({queries.ORACLES['op5_quality']}) WHERE kept").fetchall()]
    cut = brute_line_dedup(rows, spare_copies=True)
    rows = [(i, t) for (i, was), (_, t) in zip(rows, cut, strict=True) if t == was or t.split()]
    components = brute_components(rows, 80)
    rows = [(i, t) for i, t in rows if components[i] == i]
    items = [shingles(t) for _, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    rows = [(i, t) for i, t in rows if not any(s and 100 * len(s & shingles(t)) >= 80 * len(s) for s in items)]
    docs = queries.documents(spark, SF)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k == 3:
            assert sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()) == sorted(rows) and len(rows) > 50
    got = docs.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    sizes = {i: len(t.encode().split()) for i, t in rows}
    assert all(r.size == sizes[r.doc_id] and r.taken in (0, r.size, 2 * r.size) for r in got)


def test_pipeline(spark):
    docs = queries.documents(spark, SF)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    assert out.count() == docs.count()
    left = {i: shingles(t) for i, t in docs.select("doc_id", "text").collect()}
    for _, t in queries.documents(spark, SF, "benchmark").select("item_id", "text").collect():
        s = shingles(t)
        assert not any(100 * len(s & d) >= 80 * len(s) for d in left.values())
