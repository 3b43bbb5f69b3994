"""URL filters as a Bloom filter cascade.

A rule is a host and the start of a path, written `host/path`. It fits a url of that host or of a
subdomain whose path starts with the rule's path; the longest rule that fits wins. Candidate keys
of a url are its host's suffixes joined with those starts of its path that are as long as some
rule's path, so a rule fits exactly when it is a candidate key.

Membership of a key in a list is answered by a cascade. Level 1 is a Bloom filter of the listed
keys; level 2 holds the keys of the corpus's complete key universe that level 1 takes wrongly;
level 3 those listed keys that level 2 takes wrongly, and so on until a level takes none wrongly.
A key is listed if the first level that doesn't hold it is an even one (or none is, and the number
of levels is odd). Over the universe this is exact, and a query is a few bit tests: no join.

Level 1 is sized by the part that the listed keys are of the universe, so that later levels stay
about as small as the list; the others take half of the keys they don't hold. All bits of a key lie
in one block. Levels of up to LITERAL_BITS are literals in the plan; larger ones are tables of
blocks, which the distinct keys meet by an equi-join on the block's number: the cascade is the same.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and gets
the default verdict; empty rule lists fit nothing; a key listed under both kinds is blocked; repeated
rows and other columns stay, those named like an added one with `_given` after their name; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, column, set_aside, stored, unused_name

#: Bits of a block at most, hashes of a key at most, and bits of a level that are a literal at most.
BLOCK, HASHES, LITERAL_BITS = 4096, 16, 1 << 23


@dataclass(frozen=True)
class Level:
    number: int
    blocks: int
    block_bits: int
    hashes: int
    words: tuple[int, ...] | None  # 64 bits each, by place
    table: DataFrame | None = None  # (block, words): array of 64 bits each, instead


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + F.lit(3), F.length(url))
    return F.when(at > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = url.substr(at + F.lit(3), F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url, longest host first, longest path first."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in sorted(lengths, reverse=True)]), lambda n: n <= F.length(path))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(starts, lambda n: F.concat(h, path.substr(F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(keys)


def _hash(key: Column, number: int) -> Column:
    return F.xxhash64(key, F.lit(number))


def _block(h: Column, level: Level) -> Column:
    return F.pmod(h, F.lit(level.blocks))


def _bits(h: Column, level: Level) -> list[Column]:
    """Places of a key's bits in its block."""
    a, b = F.xxhash64(h), F.xxhash64(h, F.lit(1))
    return [F.pmod(F.shiftrightunsigned(a, 16) + k * F.shiftrightunsigned(b, 16), F.lit(level.block_bits)) for k in range(level.hashes)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def _all_set(words: Column, first: Column, places: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [F.get(words, (first + F.floor(p / 64)).cast("int")).bitwiseAND(_bit(p)) != 0 for p in places])


def _has(key: Column, level: Level) -> Column:
    """Whether a literal level has the key. The words are one string, which is parsed once, when the plan is made."""
    words = F.split(F.lit(",".join(map(str, level.words))), ",").cast("array<bigint>")
    h = _hash(key, level.number)
    return _all_set(words, _block(h, level) * (level.block_bits // 64), _bits(h, level))


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    """The keys that a level has, rightly or wrongly."""
    if level.words is not None:
        return keys.filter(_has(F.col("key"), level))
    h = _hash(F.col("key"), level.number)
    met = keys.withColumn("block", _block(h, level)).join(level.table, "block")
    return met.filter(_all_set(F.col("words"), F.lit(0), _bits(h, level))).select(*keys.columns)


def is_listed(key: Column, cascade: list[Level]) -> Column:
    """For a cascade of literal levels."""
    answer = F.lit(len(cascade) % 2 == 1)
    for k in range(len(cascade) - 1, -1, -1):
        answer = F.when(~_has(key, cascade[k]), F.lit(k % 2 == 1)).otherwise(answer)
    return answer


def listed_among(keys: DataFrame, cascade: list[Level]) -> DataFrame:
    """Those of the distinct keys that the cascade lists, level by level. The keys that pass a level
    are those for the next one; what passes an odd number of levels and no more is listed."""
    passed = [keys]
    for level in cascade:
        passed.append(_passing(passed[-1], level))
    out = None
    for k in range(1, len(passed), 2):
        these = passed[k] if k + 1 >= len(passed) else passed[k].join(passed[k + 1].select("key"), "key", "left_anti")
        out = these if out is None else out.unionByName(these)
    return keys.limit(0) if out is None else out


def _level(spark: SparkSession, keys: DataFrame, number: int, n: int, rate: float) -> Level:
    """A Bloom filter of the n keys that takes the part `rate` of others."""
    hashes = min(HASHES, max(1, math.ceil(math.log2(1 / rate))))
    bits = max(64, math.ceil(n * hashes / math.log(2)))
    block_bits = min(BLOCK, -(-bits // 64) * 64)
    level = Level(number, -(-bits // block_bits), block_bits, hashes, ())
    h = _hash(F.col("key"), number)
    spots = keys.select(_block(h, level).alias("block"), F.explode(F.array(*_bits(h, level))).alias("bit"))
    words = spots.groupBy("block", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(_bit(F.col("bit"))).alias("mask"))
    if level.blocks * block_bits <= LITERAL_BITS:
        out = [0] * (level.blocks * block_bits // 64)
        for block, word, mask in words.collect():
            out[block * (block_bits // 64) + word] = mask
        return replace(level, words=tuple(out))
    filled = F.map_from_entries(F.collect_list(F.struct("word", "mask")))
    by_block = words.groupBy("block").agg(filled.alias("of")).select("block", F.transform(F.sequence(F.lit(0), F.lit(block_bits // 64 - 1)), lambda k: F.coalesce(F.col("of")[k], F.lit(0))).alias("words"))
    return replace(level, words=None, table=stored(spark, by_block, "level"))


def build_cascade(spark: SparkSession, listed: DataFrame, universe: DataFrame) -> list[Level]:
    """listed and universe: distinct keys in a column `key`."""
    cascade: list[Level] = []
    wanted, others = listed, universe.join(listed, "key", "left_anti")
    n, rest = wanted.count(), others.count()
    while n:
        # the first level as tight as makes the second about as large as itself
        rate = 0.5 if cascade else min(0.5, max(0.5**HASHES, math.sqrt(0.5) * n / max(1, rest)))
        level = _level(spark, wanted, len(cascade), n, rate)
        wrong = stored(spark, _passing(others, level), "wrong")
        cascade.append(level)
        wanted, others, n = wrong, wanted, wrong.count()
    return cascade


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. rules: ("allow" or "block", "host/path"), as a list or as a
    table (kind, key)."""
    pages, names = set_aside(pages, ("host", "path", "rule", "verdict"))
    best = unused_name(pages, "_best")
    listed = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], "kind string, key string")
    listed = stored(spark, listed.select("key", "kind").distinct(), "rules")
    lengths = [r[0] for r in listed.select(F.length(F.substring("key", F.instr("key", "/"), 1 << 30)).alias("n")).distinct().collect()]
    link = column(names.get(url, url))
    parsed = pages.withColumns({"host": F.coalesce(host_of(link), F.lit("")), "path": F.coalesce(path_of(link), F.lit(""))})
    keys = candidate_keys(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    universe = stored(spark, parsed.select("host", "path").distinct().select(F.explode(keys).alias("key")).distinct(), "keys")
    cascades = {v: build_cascade(spark, listed.filter(F.col("kind") == v).select("key"), universe) for v in ("allow", "block")}
    order = lambda key, verdict: F.struct(F.length(key).alias("n"), F.length(F.substring_index(key, "/", 1)).alias("h"), key.alias("key"), verdict.alias("verdict"))
    if all(level.words is not None for c in cascades.values() for level in c):

        def verdict(key):
            return F.when(is_listed(key, cascades["block"]), F.lit("block")).when(is_listed(key, cascades["allow"]), F.lit("allow"))

        fits = F.filter(F.transform(keys, lambda k: order(k, verdict(k))), lambda x: x["verdict"].isNotNull())
        out = parsed.withColumn(best, F.array_max(fits))
    else:
        found = [listed_among(universe, c).withColumn("verdict", F.lit(v)) for v, c in cascades.items()]
        found = found[0].unionByName(found[1]).groupBy("key").agg(F.max("verdict").alias("verdict"))
        pairs = parsed.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key")).join(found, "key")
        pairs = pairs.groupBy("host", "path").agg(F.max(order(F.col("key"), F.col("verdict"))).alias(best))
        out = parsed.join(pairs, ["host", "path"], "left").select(*[column(c) for c in parsed.columns], best)
    return out.withColumns({"rule": F.col(best)["key"], "verdict": F.coalesce(F.col(best)["verdict"], F.lit(default))}).drop(best)
