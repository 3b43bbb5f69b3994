"""One query an operator, over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, licence, linededup, mixing, neardup, quality, suffix, urlfilter
from .common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(spark, documents(spark, sf_dir), share=1.5, max_epochs=2.0, weights=lambda s: mixing.cyclic_weights(s, (3.0, 1.0, 2.0)))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(spark, documents(spark, sf_dir), threshold=85)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(spark, documents(spark, sf_dir))


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge_urls(spark, pages, RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = quality.judge(spark, docs, measures=names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *names, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence.scan(spark, documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), threshold=80)


CONTROL = r"\### Assistant: </turn> ok"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_records(chat.message_records(rows.unionByName(more))))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(spark, documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(spark, documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_near_dedup, op3_lm_scoring, op4_url_filter, op5_quality, op6_licences, op7_decontamination, op8_chat, op9_suffix_dedup, op10_line_dedup)}

_W = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op4_url_filter": """
WITH p AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS t(verdict, h, s)),
f AS (SELECT page_id, host, path, r.h || r.s AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.s) DESC NULLS LAST) AS k
      FROM q LEFT JOIN r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.s))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
    "op8_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) AS v(conv_id, turn, role, text)),
e AS (SELECT *, length(replace(replace(replace(replace(text, '\', '\\'), '<turn', '\<turn'), '</turn', '\</turn'), '###', '\###')) AS n FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + n + 17)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op5_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, {_W}) AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_W})) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w))),
rep AS (SELECT r, count(DISTINCT i + k.k) AS n FROM g, (VALUES (0), (1), (2)) AS k(k) WHERE n >= 2 GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (SELECT r, x, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) GROUP BY r, x) GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, coalesce(top.n, 0) AS top_n,
  len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS alpha FROM w LEFT JOIN rep USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id::BIGINT AS doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND 100 * n_dup_lines <= 60 * n_lines AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * alpha >= 7 * n_words AND top_n <= 0.3 * n_words AS kept
FROM b""",
    "op7_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_W}) AS ws FROM documents),
i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all({_LOWER}, {_W}) AS ws FROM benchmark),
ig AS (SELECT DISTINCT q, item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT q, item_id, ws, least(5, len(ws)) AS k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
n AS (SELECT q, count(*) AS n FROM ig GROUP BY q),
ks AS (SELECT DISTINCT k FROM ig),
dg AS (SELECT DISTINCT r, doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS g FROM (SELECT r, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks WHERE len(ws) >= k)),
s AS (SELECT r, doc_id, q, item_id, count(*) AS shared FROM dg JOIN ig USING (k, g) GROUP BY ALL)
SELECT doc_id::BIGINT AS doc_id, item_id::BIGINT AS item_id, n.n::BIGINT AS n_item_shingles, shared::BIGINT AS n_shared FROM s JOIN n USING (q) WHERE 100 * shared >= 80 * n.n""",
}
