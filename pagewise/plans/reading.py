"""Queries over files that are made from the driver's tables and read back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..limits import Limits
from ..ocr import engine as ocr
from ..operators import layout, read, route, scan, vision
from ..sources import archive, raster
from . import catalog, samples
from .catalog import query, table


#: Bytes of files that are handed on together.
TOGETHER = 1 << 20


def made(rows: DataFrame, make: Callable[[Iterator], bytes], name: str) -> DataFrame:
    """rows (file_id, parts) to files (file_id, filename, content). A part at a time is taken from its batch,
    and files leave as they are made."""

    def files(ids: list, contents: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([name] * len(ids), pa.string()), pa.array(contents, pa.binary())], names=["file_id", "filename", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, contents, size = [], [], 0
            for file_id, parts in zip(*b.columns, strict=True):
                ids.append(file_id.as_py())
                contents.append(make(part.as_py() for part in parts))
                size += len(contents[-1])
                if size >= TOGETHER:
                    yield files(ids, contents)
                    ids, contents, size = [], [], 0
            if ids:
                yield files(ids, contents)

    return rows.select("file_id", "parts").mapInArrow(run, "file_id bigint, filename string, content binary")


#: Text as files carry it in these queries: printable ASCII, so that SQL can say what comes back.
_ASCII = "regexp_replace({0}, '[^\\x20-\\x7E\\n]', '?', 'g')"
_LINES = "list_filter(list_transform(string_split(" + _ASCII + ", chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _plain(c):
    return F.regexp_replace(c, r"[^\x20-\x7E\n]", "?")


def _parts(c):
    # trim itself has a second parameter, in which transform would hand it the line's number as what to trim
    return F.filter(F.transform(F.split(_plain(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select(F.col("doc_id").alias("file_id"), _parts("text").alias("parts"))


_TURNS = "WITH t AS (SELECT conv_id AS file_id, turn, role, " + _LINES.format("text") + " AS lines FROM conversations WHERE text IS NOT NULL) "


def _turns(spark, sf_dir):
    """A file a conversation, a part a turn: its role and its lines."""
    c = table(spark, sf_dir, "conversations").filter("text is not null")
    part = F.struct("turn", "role", _parts("text").alias("lines"))
    return c.groupBy(F.col("conv_id").alias("file_id")).agg(F.array_sort(F.collect_list(part)).alias("parts"))


def _turn_pairs(parts) -> list[tuple[str, list[str]]]:
    return [(f"{p['turn']} {p['role']}", list(p["lines"])) for p in parts]


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("file_id", "format", "markdown", F.col("page_count").cast("long").alias("page_count"), "complete", F.col("error").isNull().alias("ok"))


_DOC_SQL = "SELECT doc_id AS file_id, '{fmt}' AS format, coalesce(array_to_string(" + _LINES.format("text") + ", chr(10) || chr(10)), '') AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM documents WHERE text IS NOT NULL"


@query(_DOC_SQL.format(fmt="docx"))
def read_docx(spark, sf_dir):
    return _text(read.read_documents(made(_documents(spark, sf_dir), samples.docx, "a.docx")))


@query(_DOC_SQL.format(fmt="rtf"))
def read_rtf(spark, sf_dir):
    return _text(read.read_documents(made(_documents(spark, sf_dir), samples.rtf, "a.rtf")))


_BLOCKS = "string_agg('## ' || turn || ' ' || role || CASE WHEN len(lines) > 0 THEN chr(10) || chr(10) ELSE '' END || array_to_string(lines, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY turn, role, lines)"


@query(_TURNS + "SELECT file_id, 'pptx' AS format, " + _BLOCKS + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM t GROUP BY file_id")
def read_pptx(spark, sf_dir):
    return _text(read.read_documents(made(_turns(spark, sf_dir), lambda p: samples.pptx(_turn_pairs(p)), "a.pptx")))


@query(_TURNS + "SELECT file_id, 'odp' AS format, " + _BLOCKS + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM t GROUP BY file_id")
def read_odp(spark, sf_dir):
    return _text(read.read_documents(made(_turns(spark, sf_dir), lambda p: samples.odp(_turn_pairs(p)), "a.odp")))


_SQUEEZED = _BLOCKS.replace("array_to_string(lines,", "array_to_string(list_transform(lines, lambda x: regexp_replace(x, ' +', ' ', 'g')),")


@query(_TURNS + "SELECT file_id, 'epub' AS format, " + _SQUEEZED + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM t GROUP BY file_id")
def read_epub(spark, sf_dir):
    return _text(read.read_documents(made(_turns(spark, sf_dir), lambda p: samples.epub(_turn_pairs(p)), "a.epub")))


@query("SELECT item_id AS file_id, 'odt' AS format, '## Item ' || item_id || CASE WHEN len(ls) > 0 THEN chr(10) || chr(10) || array_to_string(ls, chr(10) || chr(10)) ELSE '' END AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM (SELECT item_id, " + _LINES.format("coalesce(text, '')") + " AS ls FROM benchmark)")
def read_odt(spark, sf_dir):
    head = F.concat(F.lit("Item "), F.col("item_id").cast("string"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("file_id"), F.concat(F.array(head), _parts(F.coalesce("text", F.lit("")))).alias("parts"))
    return _text(read.read_documents(made(b, lambda p: samples.odt(next(p), p), "a.odt")))


_ROWS = "WITH c AS (SELECT c_nationkey AS file_id, c_custkey, regexp_replace(c_name, '[^\\x20-\\x7E]', '?', 'g') AS n, c_mktsegment AS s FROM customer) "
_GRID = "'| key | name | segment |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || c_custkey || ' | ' || trim(n) || ' | ' || trim(s) || ' |', chr(10) ORDER BY c_custkey)"


def _customers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    row = F.struct("c_custkey", F.trim(F.regexp_replace("c_name", r"[^\x20-\x7E]", "?")).alias("n"), F.trim("c_mktsegment").alias("s"))
    return c.groupBy(F.col("c_nationkey").cast("long").alias("file_id")).agg(F.array_sort(F.collect_list(row)).alias("parts"))


def _grid(parts) -> Iterator[list[str]]:
    yield ["key", "name", "segment"]
    yield from ([str(p["c_custkey"]), p["n"], p["s"]] for p in parts)


@query(_ROWS + "SELECT file_id::BIGINT AS file_id, 'xlsx' AS format, '## Customers' || chr(10) || chr(10) || " + _GRID + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM c GROUP BY file_id")
def read_xlsx(spark, sf_dir):
    return _text(read.read_documents(made(_customers(spark, sf_dir), lambda p: samples.xlsx([("Customers", _grid(p))]), "a.xlsx")))


@query(_ROWS + "SELECT file_id::BIGINT AS file_id, 'ods' AS format, '## Customers' || chr(10) || chr(10) || " + _GRID + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM c GROUP BY file_id")
def read_ods(spark, sf_dir):
    return _text(read.read_documents(made(_customers(spark, sf_dir), lambda p: samples.ods("Customers", _grid(p)), "a.ods")))


@query(_ROWS + "SELECT file_id::BIGINT AS file_id, 'csv' AS format, " + _GRID + " AS markdown, 1::BIGINT AS page_count, true AS complete, true AS ok FROM c GROUP BY file_id HAVING count(*) >= 2")
def read_csv(spark, sf_dir):
    several = _customers(spark, sf_dir).filter(F.size("parts") >= 2)
    return _text(read.read_documents(made(several, lambda p: "\n".join(";".join(r) for r in _grid(p)).encode(), "a.txt")))


_PDF = _TURNS + """, p AS (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY turn, role, lines) AS number, CASE WHEN role = 'user' THEN NULL ELSE list_transform(lines, lambda x: regexp_replace(x, ' +', ' ', 'g')) END AS ls FROM t),
d AS (SELECT file_id, count(*) AS n, count(*) FILTER (ls IS NULL) AS scans, coalesce(string_agg(array_to_string(ls, chr(10)), chr(10) || chr(10) ORDER BY number) FILTER (len(ls) > 0), '') AS markdown,
  coalesce(string_agg(number::VARCHAR, ',' ORDER BY number) FILTER (ls IS NULL OR len(ls) = 0), '') AS unresolved FROM p GROUP BY file_id) """


def _pdfs(spark, sf_dir, **options):
    """Users' turns are pictures, the others text."""
    return made(_turns(spark, sf_dir), lambda p: samples.pdf([None if x["role"] == "user" else list(x["lines"]) for x in p], **options), "a.pdf")


@query(_PDF + "SELECT file_id, n::BIGINT AS pages, CASE WHEN scans = 0 THEN 'text' WHEN scans >= n THEN 'scanned' ELSE 'mixed' END AS kind, markdown, unresolved, unresolved = '' AS complete FROM d")
def read_pdf(spark, sf_dir):
    docs = read.read_documents(_pdfs(spark, sf_dir))
    return docs.select("file_id", F.col("page_count").cast("long").alias("pages"), "kind", "markdown", F.array_join(F.col("unresolved_pages").cast("array<string>"), ",").alias("unresolved"), "complete")


@query(_PDF + "SELECT file_id, scans > 0 AS needs_ocr, scans::BIGINT AS ocr_pages, CASE WHEN scans = 0 THEN 'text PDF, ' || n || ' pages, no OCR needed' WHEN scans >= n THEN 'scanned PDF, all ' || n || ' pages need OCR' ELSE 'mixed PDF, ' || n || ' pages, ' || scans || ' need OCR' END AS summary FROM d")
def inspect_pdf(spark, sf_dir):
    plans = route.inspect(_pdfs(spark, sf_dir), survey=True)
    return plans.select("file_id", "needs_ocr", F.col("ocr_page_count").cast("long").alias("ocr_pages"), "summary")


@query(_PDF + "SELECT file_id, 'empty password' AS case_, markdown, NULL AS error FROM d UNION ALL SELECT file_id, 'password', markdown, NULL FROM d UNION ALL SELECT file_id, 'none', NULL, 'password_required' FROM d UNION ALL SELECT file_id, 'wrong', NULL, 'password_rejected' FROM d")
def read_encrypted_pdf(spark, sf_dir):
    opened, locked = _pdfs(spark, sf_dir, password=""), _pdfs(spark, sf_dir, password="sesame")
    cases = {"empty password": (opened, None), "password": (locked, "sesame"), "none": (locked, None), "wrong": (locked, "open")}
    out = [read.read_documents(f, password=p).select("file_id", F.lit(k).alias("case_"), "markdown", F.col("error.kind").alias("error")) for k, (f, p) in cases.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query(_PDF + """, l AS (SELECT file_id, n, scans, markdown FROM d) SELECT file_id, CASE WHEN n > 4 THEN 'too_large' WHEN scans > 0 OR unresolved <> '' THEN 'ocr_required' END AS kind,
CASE WHEN n > 4 THEN 'refused: pages is ' || n || ', over the limit of 4' WHEN unresolved <> '' THEN len(string_split(unresolved, ',')) || ' page(s) need OCR and no OCR backend is configured' END AS message FROM d""")
def read_refusals(spark, sf_dir):
    docs = read.read_documents(_pdfs(spark, sf_dir), limits=Limits(pages=4), strict=True)
    return docs.select("file_id", F.col("error.kind").alias("kind"), F.col("error.message").alias("message"))


_ZIP = "WITH z AS (SELECT doc_id AS file_id, octet_length(encode(" + _ASCII.format("text") + ")) AS n, doc_id % 4 AS k FROM documents WHERE text IS NOT NULL) "


@query(_ZIP + "SELECT file_id, CASE WHEN k = 0 AND 3 > 2 THEN 'archive entries' WHEN k = 1 AND n > 2000 THEN 'declared decompressed bytes' WHEN k = 2 AND n > 2000 THEN 'decompressed bytes' WHEN k = 3 THEN 'archive nesting depth' END AS limit_, CASE WHEN k = 0 THEN 3 WHEN k = 1 AND n > 2000 THEN n WHEN k = 3 THEN 2 END::BIGINT AS found FROM z")
def archive_check(spark, sf_dir):
    """By doc_id: too many entries, too many bytes, too many bytes under a false size, archives in archives."""

    def make(parts) -> bytes:
        kind, body = parts
        kind, body = int(kind), body.encode()
        if kind == 0:
            return samples.package({"a": "1", "b": "2", "c": "3"})
        if kind == 3:
            return samples.package({"a": samples.package({"b": samples.package({"c": "1"})})})
        out = bytearray(samples.package({"a": body}))
        if kind == 2:
            for mark, at in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):
                k = out.index(mark) if at == 22 else out.rindex(mark)
                out[k + at : k + at + 4] = (1).to_bytes(4, "little")
        return bytes(out)

    d = table(spark, sf_dir, "documents").filter("text is not null")
    files = made(d.select(F.col("doc_id").alias("file_id"), F.array((F.col("doc_id") % 4).cast("string"), _plain("text")).alias("parts")), make, "a.zip")
    found = archive.check_files(files.withColumn("path", F.col("file_id").cast("string")), Limits(archive_bytes=2000, archive_entries=2, archive_depth=1))
    return found.select(F.col("path").cast("long").alias("file_id"), F.col("exceeded.limit").alias("limit_"), F.col("exceeded.found").alias("found"))


_LEVELS = "WITH px AS (SELECT vec_id AS file_id, unnest(range(64)) AS i, unnest(list_transform(embedding::DOUBLE[], lambda v: 255 - greatest(0, least(255, floor(abs(v) * 512)))::INT)) AS v FROM embeddings) "


def _images(spark, sf_dir, scale: int):
    """8 x 8 pages of an embedding's values, each a square of pixels, as PNG."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grids = [255 - np.clip(np.floor(np.abs(np.asarray(v, float)) * 512), 0, 255).astype(np.uint8).reshape(8, 8) for v in b["embedding"]]
            yield pd.DataFrame({"file_id": b["vec_id"], "filename": "a.png", "content": [raster.encode_png(np.kron(g, np.ones((scale, scale), np.uint8))) for g in grids]})

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "file_id bigint, filename string, content binary")


@query(_LEVELS + "SELECT file_id::BIGINT AS file_id, 8 AS width, 8 AS height, sum(v * (i + 1))::BIGINT AS checksum FROM px GROUP BY file_id")
def prepare_images(spark, sf_dir):
    got = scan.prepare_images(_images(spark, sf_dir, 1), profile="rendered_page", key="file_id")
    return _checksums(got, "width", "height")


def _checksums(images: DataFrame, *more: str) -> DataFrame:
    level = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.hex(F.substring(F.col("pixels"), i + 1, F.lit(1))), 16, 10).cast("long") * (i + 1))
    return images.select("file_id", *more, F.aggregate(level, F.lit(0).cast("long"), lambda a, x: a + x).alias("checksum"))


class Quarters:
    """A detector that finds the four quarters of any page."""

    def detect(self, image):
        h, w = image.shape
        return [((x, y), (x + w / 2, y), (x + w / 2, y + h / 2), (x, y + h / 2)) for y in (0, h / 2) for x in (0, w / 2)]


class Greys:
    """A recogniser that reads a crop's mean level."""

    def recognize(self, crop):
        return f"g{int(crop.mean())}", 0.9

    def recognize_batch(self, crops):
        return [self.recognize(c) for c in crops]


_QUARTERS = _LEVELS + ", q AS (SELECT file_id, i // 32 AS qy, (i % 8) // 4 AS qx, 'g' || floor(avg(v))::INT AS t FROM px GROUP BY ALL) "


@query(_QUARTERS + "SELECT file_id::BIGINT AS file_id, string_agg(l, chr(10) ORDER BY qy) AS markdown, 1::BIGINT AS recognised, 0::BIGINT AS unresolved, '1 page(s): 0 extracted, 1 recognised, 0 unresolved, 0 marked for a person' AS receipt FROM (SELECT file_id, qy, string_agg(t, ' ' ORDER BY qx) AS l FROM q GROUP BY ALL) GROUP BY file_id")
def scan_images(spark, sf_dir):
    engine = ocr.Engine(Quarters(), Greys(), ocr.profile("rendered_page"))
    docs = read.read_documents(_images(spark, sf_dir, 4), backend=engine)
    return docs.select("file_id", "markdown", F.size("ocr_pages").cast("long").alias("recognised"), F.size("unresolved_pages").cast("long").alias("unresolved"), F.regexp_replace("receipt", ", in .*", "").alias("receipt"))


_HUMAN = catalog._REGIONS + """, f AS (SELECT g.file_id, (o.o_custkey * 11 % 400)::DOUBLE AS rx, t.line_no, (SELECT min(line_no) FROM ln WHERE ln.file_id = g.file_id AND ln.baseline_y > g.ry + g.rh / 2) AS before
  FROM g JOIN orders o ON o.o_orderkey = g.file_id LEFT JOIN t ON g.file_id = t.file_id AND t.k = 1),
cells AS (SELECT l.file_id, l.line_no, l.text, l.x, 0 AS kind, row_number() OVER (PARTITION BY l.file_id, l.line_no ORDER BY l.x, l.cy, l.box_idx) AS pos FROM l UNION ALL SELECT file_id, line_no, '[handwritten]', rx, 1, 0 FROM f WHERE line_no IS NOT NULL),
h AS (SELECT file_id, line_no::DOUBLE AS k, string_agg(text, ' ' ORDER BY x, kind, pos) AS text FROM cells GROUP BY ALL UNION ALL SELECT file_id, coalesce(before, 1000000) - 0.5, '[handwritten]' FROM f WHERE line_no IS NULL) """


def _written(spark, sf_dir):
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), (F.col("o_custkey") * 11 % 400).cast("double").alias("x"))
    return layout.written(catalog._boxes(spark, sf_dir), catalog._regions(spark, sf_dir).join(x, "file_id"), parts=catalog.shares(table(spark, sf_dir, "lineitem")))


@query(_HUMAN + "SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY k) - 1 AS line_no, text FROM h")
def human_lines(spark, sf_dir):
    return _written(spark, sf_dir).select("file_id", F.inline("lines")).select("file_id", F.col("line_no").cast("long").alias("line_no"), "text")


@query(_HUMAN + "SELECT file_id, string_agg(text, chr(10) ORDER BY k) AS text FROM h GROUP BY file_id")
def scan_text(spark, sf_dir):
    return layout.scan_text(_written(spark, sf_dir)).select("file_id", "text")


@query("""WITH p AS (SELECT vec_id, unnest(range(64)) AS x, unnest(embedding::DOUBLE[]) AS y FROM embeddings),
s AS (SELECT a.vec_id, list_sort(list((b.y - a.y) / (b.x - a.x))) AS ss FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.x < b.x GROUP BY a.vec_id),
m AS (SELECT vec_id, ss[round(0.5 * (len(ss) - 1))::INT + 1] AS slope FROM s)
SELECT vec_id, round(slope, 9) AS slope, round((list_sort(list(y - slope * x)))[round(0.5 * 63)::INT + 1], 9) AS intercept FROM p JOIN m USING (vec_id) GROUP BY vec_id, slope""")
def theil_sen(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    line = vision.theil_sen(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i.cast("double")), F.col("embedding").cast("array<double>"))
    return e.select("vec_id", line.alias("l")).select("vec_id", F.round("l.slope", 9).alias("slope"), F.round("l.intercept", 9).alias("intercept"))


@query(_LEVELS + "SELECT file_id::BIGINT AS file_id, sum(least(255, v * 255 // greatest(1, bg)) * (i + 1))::BIGINT AS checksum FROM px JOIN (SELECT file_id, sum(v) // 64 AS bg FROM px GROUP BY file_id) USING (file_id) GROUP BY file_id")
def flatten_lighting(spark, sf_dir):
    """On pages of 8 x 8 pixels the neighbourhood of each is the whole page."""
    only = ocr.ScanOptions(crop_to_content=False, fix_orientation=False, fix_skew=False)
    return _checksums(scan.prepare_images(_images(spark, sf_dir, 1), options=only, key="file_id"))


@query(_LEVELS + "SELECT file_id::BIGINT AS file_id, sum(v * (8 * CASE file_id % 4 WHEN 1 THEN i % 8 WHEN 2 THEN 7 - i // 8 WHEN 3 THEN 7 - i % 8 ELSE i // 8 END + CASE file_id % 4 WHEN 1 THEN 7 - i // 8 WHEN 2 THEN 7 - i % 8 WHEN 3 THEN i // 8 ELSE i % 8 END + 1))::BIGINT AS checksum FROM px WHERE file_id % 4 <> 2 GROUP BY file_id")
def turn_images(spark, sf_dir):
    """Each page by the turn that is given for it; half a turn resamples and is left to the tests."""
    images = _images(spark, sf_dir, 1)
    flat = ocr.profile("rendered_page")
    out = [scan.prepare_images(images.filter(F.col("file_id") % 4 == k), options=replace(flat, turn=90 * k), key="file_id") for k in (0, 1, 3)]
    return _checksums(out[0].unionByName(out[1]).unionByName(out[2]))
