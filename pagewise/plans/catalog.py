"""Every query the engine answers over the driver's tables, with the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.text import is_blank, parse_charset, sniff_delimited
from ..limits import exceeded, message, pixels_within
from ..operators import account, confidence, ctc, layout, markdown, route, vision

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def note(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return note


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of files for each task that their rows are dealt to, so that its share doesn't grow with the table.
SHARE = 4 << 20


def shares(files: DataFrame) -> int:
    stored = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(files.sparkSession.sparkContext.defaultParallelism, -(-stored // SHARE))


# ---------------------------------------------------------------- routing

_SNIFF = r"""
WITH l AS (SELECT doc_id, lang, octet_length(encode(text)) AS bytes, list_transform(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))[1:12],
    lambda x: regexp_replace(regexp_replace(x, '\r$', ''), '"[^"]*("|$)', '', 'g')) AS ls FROM documents),
d AS (SELECT doc_id, lang, bytes, len(ls) AS n, d.k, d.c, list_transform(ls, lambda x: length(x) - length(replace(x, d.c, ''))) AS cs
      FROM l, (VALUES (1, ','), (2, ';'), (3, chr(9)), (4, '|')) AS d(k, c)),
s AS (SELECT doc_id, lang, bytes, min(CASE WHEN n >= 3 AND cs[1] > 0 AND len(list_filter(cs, lambda c: c = cs[1])) >= n - 1 THEN k END) AS k FROM d GROUP BY ALL),
r AS (SELECT doc_id, lang, bytes, [',', ';', chr(9), '|'][k] AS delimiter, CASE WHEN bytes = 0 THEN 'empty' WHEN k IS NOT NULL THEN 'office' ELSE 'unknown' END AS route FROM s)
"""


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.encode("text", "UTF-8").alias("content"))


@query(_SNIFF + "SELECT doc_id, route, CASE WHEN route = 'office' THEN 'csv' END AS format, CASE route WHEN 'office' THEN 'Csv document, no OCR needed' ELSE 'unrecognised' END AS summary, false AS needs_ocr FROM r")
def route_documents(spark, sf_dir):
    plans = route.inspect(_files(spark, sf_dir))
    return plans.select("doc_id", "route", "format", route.summary(F.col("route"), F.col("format"), F.lit(0), F.lit(0)).alias("summary"), "needs_ocr")


@query(_SNIFF + "SELECT lang, route, count(*)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM r GROUP BY ALL")
def route_summary(spark, sf_dir):
    files = _files(spark, sf_dir).withColumn("bytes", F.length("content").cast("long"))
    return route.inspect(files).groupBy("lang", "route").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query(_SNIFF + "SELECT delimiter, count(*)::BIGINT AS files FROM r WHERE delimiter IS NOT NULL GROUP BY ALL")
def sniff_counts_by_delimiter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(sniff_delimited(F.col("text")).alias("delimiter"))
    return d.filter("delimiter is not null").groupBy("delimiter").agg(F.count("*").alias("files"))


@query(_SNIFF + ", n AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'csv' WHEN 1 THEN 'docx' WHEN 2 THEN 'pdf' ELSE 'txt' END AS ext FROM r) SELECT doc_id, CASE WHEN route = 'unknown' AND ext IN ('csv', 'docx') THEN 'office' ELSE route END AS route, CASE WHEN route = 'office' THEN 'csv' WHEN ext IN ('csv', 'docx') AND route <> 'empty' THEN ext END AS format FROM n")
def route_named(spark, sf_dir):
    ext = F.get(F.array(*[F.lit(x) for x in ("csv", "docx", "pdf", "txt")]), (F.col("doc_id") % 4).cast("int"))
    files = _files(spark, sf_dir).withColumn("filename", F.concat(F.lit("f."), ext))
    return route.inspect(files).select("doc_id", "route", "format")


@query(_SNIFF.replace("doc_id, lang, octet_length(encode(text)) AS bytes", "page_id AS doc_id, '' AS lang, octet_length(encode(html)) AS bytes").replace("string_split(text", "string_split(html").replace("FROM documents", "FROM pages") + "SELECT doc_id AS page_id, route FROM r")
def route_pages_html(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return route.inspect(p).select("page_id", "route")


@query("SELECT doc_id, 'input size is ' || octet_length(encode(text)) || ', over the limit of 4096' AS message FROM documents WHERE octet_length(encode(text)) > 4096")
def size_refusals(spark, sf_dir):
    size = F.octet_length("text").cast("long")
    d = table(spark, sf_dir, "documents").withColumn("e", exceeded("input size", 4096, size, size > 4096)).filter("e is not null")
    return d.select("doc_id", message(F.col("e.limit"), F.col("e.allowed"), F.col("e.found")).alias("message"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT o_orderkey, CASE WHEN need = 0 THEN 'text' WHEN need >= pages THEN 'scanned' ELSE 'mixed' END AS kind, CASE WHEN need = 0 THEN 'text PDF, ' || pages || ' pages, no OCR needed' WHEN need >= pages THEN 'scanned PDF, all ' || pages || ' pages need OCR' ELSE 'mixed PDF, ' || pages || ' pages, ' || need || ' need OCR' END AS summary FROM (SELECT o_orderkey, 1 + o_custkey % 9 AS pages, o_orderkey % 11 AS need FROM orders)")
def pdf_kind(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_custkey") % 9).alias("pages"), (F.col("o_orderkey") % 11).alias("need"))
    return o.select("o_orderkey", route.pdf_kind(F.col("pages"), F.col("need")).alias("kind"), route.summary(F.lit("pdf"), F.lit(None).cast("string"), F.col("pages"), F.col("need")).alias("summary"))


_MAGIC = ("89504E470D0A1A0A0000000D49484452000003E8000007D0", "FFD8FFE000104A46", "FFD800010203", "424D0000", "49492A00", "52494646000000005745425056503820", "000000186674797068656963", "0000001866747970617669 66".replace(" ", ""), "000000186674797069736F6D", "474946383961", "25504446")


@query(f"SELECT item_id, (['png', 'jpeg', NULL, 'bmp', 'tiff', 'webp', 'heic', 'avif', NULL, 'gif', NULL])[(item_id % {len(_MAGIC)} + 1)::INT] AS kind, CASE WHEN item_id % {len(_MAGIC)} = 0 THEN 1000 END::BIGINT AS width, CASE WHEN item_id % {len(_MAGIC)} = 0 THEN 2000 END::BIGINT AS height FROM benchmark")
def magic_kinds(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.unhex(F.get(F.array(*[F.lit(m) for m in _MAGIC]), (F.col("item_id") % len(_MAGIC)).cast("int"))).alias("content"))
    size = route.png_size(F.col("content"))
    return b.select("item_id", route.image_kind(F.col("content")).alias("kind"), size["width"].alias("width"), size["height"].alias("height"))


# ---------------------------------------------------------------- accounting

_PAGES = """WITH p AS (SELECT conv_id AS file_id, turn + 1 AS number, text AS markdown, CASE role WHEN 'assistant' THEN 'text' WHEN 'user' THEN 'ocr' ELSE 'unresolved' END AS origin, (length(text) % 3)::BIGINT AS human FROM conversations) """


def _pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    origin = F.when(F.col("role") == "assistant", "text").when(F.col("role") == "user", "ocr").otherwise("unresolved")
    return c.select(F.col("conv_id").alias("file_id"), (F.col("turn") + 1).alias("number"), F.col("text").alias("markdown"), origin.alias("origin"), (F.length("text") % 3).cast("long").alias("human_regions"))


_TRIM = r"regexp_replace(markdown, '^\s+|\s+$', '', 'g')"


@query(_PAGES + rf"SELECT file_id, coalesce(string_agg({_TRIM}, chr(10) || chr(10) ORDER BY number) FILTER (regexp_matches(markdown, '\S')), '') AS markdown FROM p GROUP BY file_id")
def join_pages(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("file_id").agg(account.join_pages().alias("markdown"))


@query(_PAGES + rf"SELECT file_id, coalesce(string_agg('<!-- Page ' || number || ' -->' || chr(10) || chr(10) || {_TRIM}, chr(10) || chr(10) ORDER BY number) FILTER (regexp_matches(markdown, '\S')), '') AS markdown FROM p GROUP BY file_id")
def join_pages_markers(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("file_id").agg(account.join_pages(markers=True).alias("markdown"))


@query(_PAGES + "SELECT file_id, count(*) || ' page(s): ' || count(*) FILTER (origin = 'text') || ' extracted, ' || count(*) FILTER (origin = 'ocr') || ' recognised, ' || count(*) FILTER (origin = 'unresolved') || ' unresolved, ' || sum(human) || ' marked for a person' AS receipt FROM p GROUP BY file_id")
def receipts(spark, sf_dir):
    return account.roll_up(_pages(spark, sf_dir)).select("file_id", "receipt")


@query(_PAGES + "SELECT file_id, coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (origin = 'ocr'), '') AS ocr_pages, coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (origin = 'unresolved'), '') AS unresolved_pages, coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (human > 0), '') AS human_pages, count(*) FILTER (origin = 'unresolved') = 0 AS complete, count(*) FILTER (human > 0) > 0 AS needs_a_person FROM p GROUP BY file_id")
def page_rollup(spark, sf_dir):
    r = account.roll_up(_pages(spark, sf_dir))
    say = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return r.select("file_id", say("ocr_pages"), say("unresolved_pages"), say("human_pages"), "complete", "needs_a_person")


@query(_PAGES + "SELECT file_id, 'ocr_required' AS kind, count(*)::BIGINT AS pages FROM p WHERE origin = 'unresolved' GROUP BY file_id")
def strict_errors(spark, sf_dir):
    r = account.roll_up(_pages(spark, sf_dir), strict=True).filter("error is not null")
    return r.select("file_id", F.col("error.kind").alias("kind"), F.col("error.pages").alias("pages"))


@query(_PAGES + "SELECT origin, count(*)::BIGINT AS pages, sum(human)::BIGINT AS marked FROM p GROUP BY origin")
def origin_counts(spark, sf_dir):
    return _pages(spark, sf_dir).groupBy("origin").agg(F.count("*").alias("pages"), F.sum("human_regions").alias("marked"))


@query("SELECT item_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), '+') AS charset FROM benchmark")
def parse_charsets(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(parse_charset(F.col("text")), "+").alias("charset"))


# ---------------------------------------------------------------- layout

_BOXES = """WITH b AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS box_idx,
  l_returnflag || l_linestatus || l_linenumber AS text, ((l_partkey * 37) % 380)::DOUBLE AS x, ((l_suppkey * 13) % 40 * 8)::DOUBLE AS y, 20 + l_quantity AS w, (10 + 2 * l_linenumber)::DOUBLE AS h, round(1 - 6 * l_discount, 4) AS confidence FROM lineitem),
bins AS (SELECT file_id, greatest(0, least(100, floor(x / 4.2)))::INT AS a, greatest(0, least(100, ceil((x + w) / 4.2)))::INT AS z FROM b),
full_ AS (SELECT DISTINCT file_id, unnest(range(a, z)) AS bin FROM bins),
pg AS (SELECT file_id FROM b GROUP BY file_id HAVING count(*) >= 4),
gap AS (SELECT pg.file_id, r.bin FROM pg, range(15, 85) r(bin) WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.file_id = pg.file_id AND f.bin = r.bin)),
run AS (SELECT file_id, min(bin) AS s, count(*) AS n FROM (SELECT file_id, bin, bin - row_number() OVER (PARTITION BY file_id ORDER BY bin) AS g FROM gap) GROUP BY file_id, g),
gut AS (SELECT file_id, (s + n // 2) * 420.0::DOUBLE / 100 AS boundary FROM run WHERE n >= 4),
c AS (SELECT b.*, y + h / 2 AS cy, (SELECT count(*) FROM gut g WHERE g.file_id = b.file_id AND g.boundary < b.x + b.w / 2) AS k FROM b),
c2 AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY k) - 1 AS col_no FROM c),
p AS (SELECT *, lag(y) OVER v AS py, lag(h) OVER v AS ph, lag(cy) OVER v AS pcy FROM c2 WINDOW v AS (PARTITION BY file_id, col_no ORDER BY cy, box_idx)),
n AS (SELECT *, CASE WHEN least(y + h, py + ph) - greatest(y, py) >= 0.5 * greatest(least(h, ph), 1) AND abs(cy - pcy) <= 0.75 * greatest(least(h, ph), 1) THEN 0 ELSE 1 END AS new FROM p),
l AS (SELECT *, (sum(new) OVER (PARTITION BY file_id ORDER BY col_no, cy, box_idx) - 1)::INT AS line_no FROM n),
ln AS (SELECT file_id, line_no, min(col_no) AS col_no, string_agg(text, ' ' ORDER BY x, cy, box_idx) AS text, avg(cy) AS baseline_y, list_sort(list(h))[len(list(h)) // 2 + 1] AS height, min(y) AS top, max(y + h) AS bottom,
  count(*) AS n_boxes, avg(confidence) AS confidence, min(confidence) AS min_confidence FROM l GROUP BY file_id, line_no)
"""


def _boxes(spark, sf_dir):
    i = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = lambda c: c.cast("double")
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus").repartition(shares(rows), "l_orderkey").select(
        F.col("l_orderkey").alias("file_id"), F.lit(1).alias("page"), F.row_number().over(i).alias("box_idx"), F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"),
        d(F.col("l_partkey") * 37 % 380).alias("x"), d(F.col("l_suppkey") * 13 % 40 * 8).alias("y"), (20 + F.col("l_quantity")).alias("w"), d(10 + 2 * F.col("l_linenumber")).alias("h"), F.round(1 - 6 * F.col("l_discount"), 4).alias("confidence"), F.lit(420.0).alias("page_width"),
    )


@query(_BOXES + "SELECT file_id, round(boundary, 4) AS boundary FROM gut")
def gutters(spark, sf_dir):
    return layout.gutters(_boxes(spark, sf_dir)).select("file_id", F.round("boundary", 4).alias("boundary"))


@query(_BOXES + "SELECT file_id, box_idx::INT AS box_idx, col_no::INT AS col_no FROM c2")
def layout_columns(spark, sf_dir):
    return layout.split_columns(_boxes(spark, sf_dir)).select("file_id", "box_idx", "col_no")


@query(_BOXES + "SELECT file_id, box_idx::INT AS box_idx, line_no, row_number() OVER (PARTITION BY file_id, line_no ORDER BY x, cy, box_idx)::INT AS pos FROM l")
def reading_order(spark, sf_dir):
    return layout.group_into_lines(_boxes(spark, sf_dir)).select("file_id", "box_idx", "line_no", "pos")


@query(_BOXES + "SELECT file_id, line_no, col_no::INT AS col_no, text, round(baseline_y, 4) AS baseline_y, height, top, bottom, n_boxes FROM ln")
def layout_lines(spark, sf_dir):
    return layout.assemble(_boxes(spark, sf_dir)).select("file_id", "line_no", "col_no", "text", F.round("baseline_y", 4).alias("baseline_y"), "height", "top", "bottom", "n_boxes")


@query(_BOXES + "SELECT file_id, line_no, round(confidence, 4) AS confidence, min_confidence FROM ln")
def line_confidence(spark, sf_dir):
    return layout.assemble(_boxes(spark, sf_dir)).select("file_id", "line_no", F.round("confidence", 4).alias("confidence"), "min_confidence")


@query(_BOXES + "SELECT file_id, round(avg(confidence), 4) AS confidence, min(confidence) AS min_confidence, round(sum(confidence * length(text)), 4) AS read_mass, list_sort(list(confidence))[round(0.5 * (count(*) - 1))::INT + 1] AS reference, avg(confidence) < 0.6999 AS needs_review FROM b GROUP BY file_id")
def page_confidence(spark, sf_dir):
    p = confidence.page_confidence(_boxes(spark, sf_dir), review_below=0.6999)
    return p.select("file_id", F.round("confidence", 4).alias("confidence"), "min_confidence", F.round("read_mass", 4).alias("read_mass"), "reference", "needs_review")


@query(_BOXES + "SELECT file_id, line_no, box_idx::INT AS box_idx, confidence FROM l WHERE confidence < 0.5")
def weak_boxes(spark, sf_dir):
    placed = layout.group_into_lines(_boxes(spark, sf_dir))
    return confidence.weak_boxes(placed, 0.5).select("file_id", "line_no", "box_idx", "confidence")


@query(_BOXES + "SELECT file_id, line_no, min_confidence FROM ln ORDER BY min_confidence, file_id, line_no LIMIT 50")
def weakest_first(spark, sf_dir):
    return confidence.weakest_first(layout.assemble(_boxes(spark, sf_dir)), 50).select("file_id", "line_no", "min_confidence")


_MD = _BOXES + """, bh AS (SELECT file_id, list_sort(list(height))[len(list(height)) // 2 + 1] AS body FROM ln WHERE height > 0 GROUP BY file_id),
m AS (SELECT ln.*, body, lag(baseline_y) OVER (PARTITION BY ln.file_id ORDER BY line_no) AS pb, CASE WHEN height / body >= 1.6 THEN 1 WHEN height / body >= 1.3 THEN 2 WHEN height / body >= 1.15 THEN 3 END AS lv FROM ln JOIN bh USING (file_id)),
o AS (SELECT file_id, line_no, lv, body, CASE WHEN pb IS NULL THEN '' ELSE chr(10) || CASE WHEN baseline_y - pb > 1.8 * body THEN chr(10) ELSE '' END || CASE WHEN lv IS NULL THEN '' ELSE chr(10) END END
  || CASE WHEN lv IS NULL THEN '' ELSE repeat('#', lv) || ' ' END || text || CASE WHEN min_confidence < 0.5 THEN ' <!-- low confidence -->' ELSE '' END || CASE WHEN lv IS NULL THEN '' ELSE chr(10) END AS piece FROM m)
"""


@query(_MD + r"SELECT file_id, regexp_replace(string_agg(piece, '' ORDER BY line_no), '^\s+|\s+$', '', 'g') || chr(10) AS markdown FROM o GROUP BY file_id")
def markdown_pages(spark, sf_dir):
    return markdown.to_markdown(layout.pages_of(_boxes(spark, sf_dir))).select("file_id", "markdown")


@query(_MD + "SELECT file_id, body FROM bh")
def body_heights(spark, sf_dir):
    return markdown.body_heights(layout.pages_of(_boxes(spark, sf_dir))).select("file_id", "body")


@query(_MD + "SELECT file_id, line_no, lv::INT AS level FROM m WHERE lv IS NOT NULL")
def heading_levels(spark, sf_dir):
    return markdown.heading_levels(layout.pages_of(_boxes(spark, sf_dir))).select("file_id", "line_no", "level")


_REGIONS = _BOXES + ", g AS (SELECT o_orderkey AS file_id, 1 AS region_idx, ((o_custkey * 7) % 320)::DOUBLE AS ry, (8 + o_custkey % 20)::DOUBLE AS rh FROM orders), a AS (SELECT g.file_id, region_idx, ry, rh, line_no, (least(ry + rh, bottom) - greatest(ry, top)) / greatest(least(bottom - top, rh), 1) AS part FROM g JOIN ln USING (file_id)), t AS (SELECT *, row_number() OVER (PARTITION BY file_id, region_idx ORDER BY part DESC, line_no DESC) AS k FROM a WHERE part >= 0.5)"


def _regions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), F.lit(1).alias("page"), F.lit(1).alias("region_idx"), (F.col("o_custkey") * 7 % 320).cast("double").alias("y"), (8 + F.col("o_custkey") % 20).cast("double").alias("h"))


@query(_REGIONS + "SELECT g.file_id, g.region_idx, t.line_no FROM g LEFT JOIN t ON g.file_id = t.file_id AND g.region_idx = t.region_idx AND t.k = 1")
def human_attach(spark, sf_dir):
    return layout.homes(layout.beside(_boxes(spark, sf_dir), _regions(spark, sf_dir), parts=shares(table(spark, sf_dir, "lineitem")))).select("file_id", "region_idx", "line_no")


@query(_REGIONS + "SELECT g.file_id, g.region_idx, (SELECT min(line_no) FROM ln WHERE ln.file_id = g.file_id AND ln.baseline_y > g.ry + g.rh / 2) AS before_line FROM g WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.file_id = g.file_id)")
def human_unmatched(spark, sf_dir):
    return layout.homes(layout.beside(_boxes(spark, sf_dir), _regions(spark, sf_dir), parts=shares(table(spark, sf_dir, "lineitem")))).filter("line_no is null").select("file_id", "region_idx", "before_line")


@query("SELECT s_suppkey, coalesce(v >= 0.8 AND d >= 0.08, false) AS human FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 13) / 10.0 END AS v, (s_suppkey % 17) / 100.0 AS d FROM supplier)")
def judge_regions(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    v, d = F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 13 / 10), F.col("s_suppkey") % 17 / 100
    return s.select("s_suppkey", confidence.is_handwriting(v, d).alias("human"))


# ---------------------------------------------------------------- recognition and vision


@query("""WITH s AS (SELECT vec_id, s.i AS i, embedding[(s.i * 8 + 1):(s.i * 8 + 8)]::DOUBLE[] AS v FROM embeddings, range(0, 8) s(i)),
a AS (SELECT vec_id, i, list_max(v) AS m, 8 - list_position(list_reverse(v), list_max(v)) AS k FROM s),
p AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY i) AS pk FROM a),
e AS (SELECT * FROM p WHERE k <> 0 AND k IS DISTINCT FROM pk)
SELECT vec_id, coalesce(string_agg(substr('abcdefg', k::INT, 1), '' ORDER BY i), '') AS text, round(coalesce(avg(m), 0), 5) AS confidence FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN e USING (vec_id) GROUP BY vec_id""")
def ctc_decode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("probs"))
    return ctc.decode_greedy(e, 8, list("abcdefg")).select("vec_id", "text", F.round("confidence", 5).alias("confidence"))


_PIXELS = """WITH px AS (SELECT vec_id AS image_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, greatest(0, least(255, floor(128 + 200 * embedding[i]::DOUBLE)))::INT AS level FROM embeddings, range(1, 65) r(i)),
hist AS (SELECT image_id, level, count(*) AS n FROM px GROUP BY ALL),
cum AS (SELECT image_id, level, sum(n) OVER v AS wb, sum(n * level) OVER v AS sb, sum(n) OVER (PARTITION BY image_id) AS w, sum(n * level) OVER (PARTITION BY image_id) AS s FROM hist WINDOW v AS (PARTITION BY image_id ORDER BY level)),
va AS (SELECT image_id, level, CASE WHEN w > wb THEN wb::DOUBLE * (w - wb) * (sb / wb::DOUBLE - (s - sb) / (w - wb)::DOUBLE) ^ 2 ELSE 0 END AS v FROM cum),
ot AS (SELECT image_id, CASE WHEN max(v) > 0 THEN first(level ORDER BY v DESC, level) ELSE 0 END AS otsu FROM va GROUP BY image_id),
dk AS (SELECT px.*, level <= otsu AS dark FROM px JOIN ot USING (image_id)),
ink AS (SELECT image_id, x, y, dark <> (sum(dark::INT) OVER (PARTITION BY image_id) * 2 > 64) AS ink FROM dk)
"""


def _pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("i", "v"))
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 200 * F.col("v").cast("double")))).cast("int")
    return e.select("image_id", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), level.alias("level"))


@query(_PIXELS + "SELECT image_id, otsu::INT AS level FROM ot")
def otsu_levels(spark, sf_dir):
    return vision.otsu_levels(_pixels(spark, sf_dir))


@query(_PIXELS + "SELECT image_id, x::INT AS x, y::INT AS y, ink FROM ink")
def ink_masks(spark, sf_dir):
    return vision.ink_mask(_pixels(spark, sf_dir)).select("image_id", "x", "y", "ink")


@query(_PIXELS + ", r AS (SELECT image_id, var_pop(c) / avg(c) ^ 2 AS v FROM (SELECT image_id, y, sum(ink::INT) AS c FROM ink GROUP BY ALL) GROUP BY image_id), q AS (SELECT image_id, var_pop(c) / avg(c) ^ 2 AS v FROM (SELECT image_id, x, sum(ink::INT) AS c FROM ink GROUP BY ALL) GROUP BY image_id) SELECT image_id, round(r.v, 6) AS across_rows, round(q.v, 6) AS across_columns, CASE WHEN round(q.v, 9) > round(1.3 * r.v, 9) THEN 90 ELSE 0 END AS rotation FROM r JOIN q USING (image_id)")
def orient_evidence(spark, sf_dir):
    e = vision.orient_evidence(vision.ink_mask(_pixels(spark, sf_dir)))
    return e.select("image_id", F.round("across_rows", 6).alias("across_rows"), F.round("across_columns", 6).alias("across_columns"), F.when(F.round("across_columns", 9) > F.round(1.3 * F.col("across_rows"), 9), 90).otherwise(0).alias("rotation"))


@query(_PIXELS + ", g AS (SELECT image_id, angle, floor(y + tan(radians(-angle)) * (x - 4.0)) AS r, count(*) AS c FROM ink, (VALUES (-14.0::DOUBLE), (0.0), (14.0)) a(angle) WHERE ink GROUP BY ALL) SELECT image_id, angle, round(sum(c * c) / 8.0 - (sum(c) / 8.0) ^ 2, 6) AS variance FROM g WHERE r >= 0 AND r < 8 GROUP BY ALL")
def projection_variance(spark, sf_dir):
    v = vision.projection_variance(vision.ink_mask(_pixels(spark, sf_dir)), [-14.0, 0.0, 14.0])
    return v.select("image_id", "angle", F.round("variance", 6).alias("variance"))


# ---------------------------------------------------------------- geometry


@query("SELECT p_partkey, round(595 * ((p_partkey % 300) / 1240.0), 4) AS x, round(842 - 842 * ((p_partkey % 500) / 1754.0) - 842 * (20 / 1754.0), 4) AS y FROM part")
def points_of_pixels(spark, sf_dir):
    v = [F.lit(float(x)) for x in (1240, 1754, 595, 842)]
    p = table(spark, sf_dir, "part").withColumn("r", geometry.pixels_to_points((F.col("p_partkey") % 300).cast("double"), (F.col("p_partkey") % 500).cast("double"), F.lit(30.0), F.lit(20.0), *v))
    return p.select("p_partkey", F.round("r.x", 4).alias("x"), F.round("r.y", 4).alias("y"))


@query("SELECT p_partkey, round((p_partkey % 300)::DOUBLE, 6) AS x, round((p_partkey % 500)::DOUBLE, 6) AS y FROM part")
def points_pixels_roundtrip(spark, sf_dir):
    v = [F.lit(float(x)) for x in (1240, 1754, 595, 842)]
    p = table(spark, sf_dir, "part").withColumn("r", geometry.pixels_to_points((F.col("p_partkey") % 300).cast("double"), (F.col("p_partkey") % 500).cast("double"), F.lit(30.0), F.lit(20.0), *v))
    p = p.withColumn("b", geometry.points_to_pixels(F.col("r.x"), F.col("r.y"), F.col("r.w"), F.col("r.h"), *v))
    return p.select("p_partkey", F.round("b.x", 6).alias("x"), (F.round("b.y", 6) + 0.0).alias("y"))


@query("SELECT p_partkey, round(CASE WHEN dpi > 288000.0 / side THEN 288000.0 / side ELSE dpi END, 4) AS dpi, dpi > 288000.0 / side AS capped FROM (SELECT p_partkey, greatest(p_size * 20, p_size * 30)::DOUBLE AS side, (100 + p_partkey % 900)::DOUBLE AS dpi FROM part)")
def cap_dpi(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("r", geometry.cap_dpi((F.col("p_size") * 20).cast("double"), (F.col("p_size") * 30).cast("double"), (100 + F.col("p_partkey") % 900).cast("double")))
    return p.select("p_partkey", F.round("r.dpi", 4).alias("dpi"), F.col("r.capped").alias("capped"))


@query("SELECT o_orderkey, CASE WHEN n >= 8 AND i >= 0.5 THEN 'use_text_layer_over_image' WHEN n >= 8 THEN 'use_text_layer' WHEN i >= 0.5 THEN 'rasterise' WHEN n = 0 AND i <= 0.01 THEN 'blank' ELSE 'rasterise' END AS plan FROM (SELECT o_orderkey, o_orderkey % 13 AS n, (o_custkey % 101) / 100.0 AS i FROM orders)")
def page_plan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", geometry.page_plan(F.col("o_orderkey") % 13, F.col("o_custkey") % 101 / 100).alias("plan"))


@query("SELECT o_orderkey, (o_custkey * 41)::DECIMAL(38,0) * (o_orderkey % 997) * 4 <= 40000000 AS allowed FROM orders")
def pixels_allowed(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", pixels_within(F.col("o_custkey") * 41, F.col("o_orderkey") % 997, F.lit(4), 40_000_000).alias("allowed"))


@query("""SELECT vec_id, round(CASE o WHEN 90 THEN v WHEN 180 THEN 399 - u WHEN 270 THEN 399 - v ELSE u END + vec_id % 31, 4) + 0.0 AS x, round(CASE o WHEN 90 THEN 199 - u WHEN 180 THEN 199 - v WHEN 270 THEN u ELSE v END + vec_id % 29, 4) + 0.0 AS y, o = 0 AND abs(s) < 0.01 AS is_identity FROM (
SELECT vec_id, o, s, CASE WHEN abs(s) < 0.01 THEN x ELSE cx + (x - cx) * cos(radians(s)) - (y - cy) * sin(radians(s)) END AS u, CASE WHEN abs(s) < 0.01 THEN y ELSE cy + (x - cx) * sin(radians(s)) + (y - cy) * cos(radians(s)) END AS v FROM (
SELECT vec_id, (vec_id % 4) * 90 AS o, (vec_id % 15 - 7)::DOUBLE AS s, (vec_id % 180)::DOUBLE AS x, (vec_id % 170)::DOUBLE AS y, CASE WHEN vec_id % 2 = 1 THEN 100.0 ELSE 200.0 END::DOUBLE AS cx, CASE WHEN vec_id % 2 = 1 THEN 200.0 ELSE 100.0 END::DOUBLE AS cy FROM embeddings))""")
def correction_map(spark, sf_dir):
    k = F.col("vec_id")
    o = (k % 4 * 90).cast("int")
    tw, th = F.when(k % 2 == 1, 200.0).otherwise(400.0), F.when(k % 2 == 1, 400.0).otherwise(200.0)
    p = geometry.to_original((k % 180).cast("double"), (k % 170).cast("double"), o, (k % 15 - 7).cast("double"), F.lit(400.0), F.lit(200.0), tw, th)
    p = geometry.to_frame(p, k % 31, k % 29)
    same = geometry.is_identity(o, (k % 15 - 7).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.round(p["x"], 4) + 0.0).alias("x"), (F.round(p["y"], 4) + 0.0).alias("y"), same.alias("is_identity"))


@query(_PIXELS + "SELECT image_id, CASE image_id % 4 WHEN 1 THEN 7 - y WHEN 2 THEN 7 - x WHEN 3 THEN y ELSE x END::INT AS x, CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN 7 - y WHEN 3 THEN 7 - x ELSE y END::INT AS y, level FROM px")
def quarter_turns(spark, sf_dir):
    p = _pixels(spark, sf_dir)
    t = geometry.quarter_turn(F.col("x"), F.col("y"), F.lit(8), F.lit(8), F.col("image_id") % 4 * 90)
    return p.select("image_id", t["x"].cast("int").alias("x"), t["y"].cast("int").alias("y"), "level")


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT vec_id, [v[1], v[3], v[5], v[7]] AS xs, [v[2], v[4], v[6], v[8]] AS ys FROM e) SELECT vec_id, list_min(xs) AS x, list_min(ys) AS y, list_max(xs) - list_min(xs) AS w, list_max(ys) - list_min(ys) AS h, list_min(ys) + (list_max(ys) - list_min(ys)) / 2 AS center_y FROM q")
def quad_bounds(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    quad = F.array(*[F.struct(v[2 * k].alias("x"), v[2 * k + 1].alias("y")) for k in range(4)])
    box = table(spark, sf_dir, "embeddings").select("vec_id", geometry.bbox(quad).alias("b"))
    return box.select("vec_id", "b.*", geometry.center_y(F.col("b.y"), F.col("b.h")).alias("center_y"))


@query(r"SELECT doc_id, NOT regexp_matches(text, '\S') AS blank FROM documents")
def blank_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", is_blank(F.col("text")).alias("blank"))


from . import reading  # noqa: E402, F401 - registers its queries here
