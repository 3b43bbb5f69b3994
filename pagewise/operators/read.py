"""Reading: files to documents, each page accounted for.

A file goes through these gates, and the first that refuses it gives its error: input size, archive,
route (empty, password, damaged PDF), page count, reader, unrecognised content, and with `strict`
pages that need OCR. A refused file is a row with an error, never a missing one. Bytes are read by a
reader in Arrow batches, a file at a time; the rest is one projection, without a shuffle. With a
backend, images take a way of their own through layout, by tables of boxes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, trimmed
from ..limits import CEILING, Limits
from ..limits import message as limit_message
from ..ocr import engine as ocr
from ..sources import archive, office, pdf
from . import layout, markdown, route, scan
from .account import receipt

_ERROR = pa.struct([("kind", pa.string()), ("message", pa.string()), ("limit", pa.string()), ("allowed", pa.int64()), ("found", pa.int64()), ("pages", pa.int64())])
_ERROR_DDL = "struct<kind:string,message:string,limit:string,allowed:bigint,found:bigint,pages:bigint>"
_PAGE = pa.struct([("number", pa.int32()), ("markdown", pa.string()), ("origin", pa.string()), ("confidence", pa.float64()), ("human_regions", pa.int64())])
_PAGE_DDL = "struct<number:int,markdown:string,origin:string,confidence:double,human_regions:bigint>"
UNRECOGNISED = "unrecognised file content; office documents, PDFs and images can be read"


def _refusal(kind: str, message: str, limit: str | None = None, allowed: int | None = None, found: int | None = None) -> dict:
    return {"kind": kind, "message": message, "limit": limit, "allowed": allowed, "found": found, "pages": None}


def _too_large(limit: str, allowed: int, found: int | None) -> dict:
    said = f"{limit} is over the limit of {allowed}" if found is None else f"{limit} is {found}, over the limit of {allowed}"
    return _refusal("too_large", f"refused: {said}", limit, allowed, found)


def _page(number: int, text: str, origin: str) -> dict:
    return {"number": number, "markdown": text, "origin": origin, "confidence": None, "human_regions": 0}


def _read_pdf(content: bytes, limits: Limits, password: str | None) -> tuple[list[dict] | None, int | None, list[int] | None, dict | None]:
    try:
        opened = pdf.Pdf(content, limits, password)
        n = pdf.page_count(opened)
        if limits.pages is not None and n > limits.pages:
            return None, n, None, _too_large("pages", limits.pages, n)
        found = list(pdf.page_texts(opened))
    except pdf.PasswordRequired as e:
        return None, None, None, _refusal("password_required", str(e))
    except pdf.PasswordRejected as e:
        return None, None, None, _refusal("password_rejected", str(e))
    except pdf.PdfError as e:
        return None, None, None, _refusal("pdf", f"PDF could not be read: {e}")
    readable = lambda p: not p.needs_ocr and p.markdown.strip()
    pages = [_page(p.number, p.markdown, "text") if readable(p) else _page(p.number, "", "unresolved") for p in found]
    return pages, n, [p.number for p in found if p.needs_ocr], None


def read_one(content: bytes | None, kind: str | None, fmt: str | None, limits: Limits, password: str | None) -> dict:
    """Pages of one file whose route is known, or its error."""
    out = {"pages": None, "page_count": None, "needing": None, "error": None}
    if content is None:
        return out
    if found := archive.check(content, limits):
        return out | {"error": _too_large(*found)}
    if kind == "empty":
        return out | {"error": _refusal("unsupported", "unsupported input: the file is empty")}
    if kind == "office":
        try:
            return out | {"pages": [_page(1, office.to_markdown(content, fmt, limits), "text")], "page_count": 1}
        except office.Unreadable as e:
            return out | {"error": _refusal("document", f"document conversion failed: {e}")}
    if kind == "pdf":
        pages, n, needing, error = _read_pdf(content, limits, password)
        return out | {"pages": pages, "page_count": n, "needing": needing, "error": error}
    if kind == "image":
        return out | {"pages": [_page(1, "", "unresolved")], "page_count": 1, "needing": [1]}
    return out | {"error": _refusal("unsupported", f"unsupported input: {UNRECOGNISED}")}


_READ = {"pages": pa.list_(_PAGE), "page_count": pa.int32(), "needing": pa.list_(pa.int32()), "error": _ERROR, "elapsed_ms": pa.int64()}


def _read(files: DataFrame, limits: Limits, password: str | None) -> DataFrame:
    """files (.., route, format, content) without content, plus pages, page_count, needing, error and elapsed_ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("content", "route", "format")}
            keep = [k for k in range(batch.num_columns) if k != at["content"]]
            for k in range(batch.num_rows):
                began = time.monotonic()
                content, kind, fmt = (batch.column(at[n])[k].as_py() for n in ("content", "route", "format"))
                got = read_one(content, kind, fmt, limits, password) | {"elapsed_ms": int((time.monotonic() - began) * 1000)}
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in keep], *[pa.array([got[n]], t) for n, t in _READ.items()]], names=[*[batch.schema.names[c] for c in keep], *_READ])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.mapInArrow(run, f"{ddl}, pages array<{_PAGE_DDL}>, page_count int, needing array<int>, error {_ERROR_DDL}, elapsed_ms bigint")


def image_pages(files: DataFrame, backend: ocr.Backend, *, mark_uncertain: bool = True) -> DataFrame:
    """files (file_id, content) to (file_id, markdown, confidence, human_regions, ocr_error, ocr_ms): what a
    backend reads of each image. One that read nothing has no confidence."""
    scans = scan.scan_images(files, backend).select("*", F.size("boxes").alias("n_boxes"), F.size("regions").alias("n_regions"))
    said = markdown.to_markdown(layout.written(scan.boxes_of(scans), scan.regions_of(scans)), mark_uncertain=mark_uncertain).select("file_id", "markdown")
    mean = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.greatest("n_boxes", F.lit(1))
    about = scans.select("file_id", F.when((F.col("n_boxes") > 0) | (F.col("n_regions") > 0), mean).alias("confidence"), F.greatest("n_regions", F.lit(0)).cast("long").alias("human_regions"), F.col("error").alias("ocr_error"), F.col("elapsed_ms").alias("ocr_ms"))
    return about.join(said, "file_id", "left")


def _joined(pages: Column, markers: bool) -> Column:
    kept = F.filter(pages, lambda p: ~is_blank(p["markdown"]))
    mark = lambda p: F.concat(F.lit("<!-- Page "), p["number"].cast("string"), F.lit(" -->\n\n")) if markers else F.lit("")
    return F.array_join(F.transform(kept, lambda p: F.concat(mark(p), trimmed(p["markdown"]))), "\n\n")


def _numbers(pages: Column, which) -> Column:
    return F.transform(F.filter(pages, which), lambda p: p["number"])


def _refused(kind: str, message: Column, limit: Column | None = None, allowed: Column | None = None, found: Column | None = None, pages: Column | None = None) -> Column:
    null = F.lit(None)
    parts = {"kind": F.lit(kind), "message": message, "limit": limit, "allowed": allowed, "found": found, "pages": pages}
    return F.struct(*[(null if v is None else v).alias(k) for k, v in parts.items()]).cast(_ERROR_DDL)


def read_documents(files: DataFrame, *, filename: str | None = "filename", backend: ocr.Backend | None = None, password: str | None = None, page_markers: bool = False, strict: bool = False, limits: Limits | None = None) -> DataFrame:
    """files (file_id, content, and a name if there is one) to documents, one row each: file_id, route,
    format, kind, summary, pages, page_count, markdown, ocr_pages, unresolved_pages, human_pages,
    complete, needs_a_person, receipt, elapsed_ms and error. A null content is an empty file."""
    limits = limits or Limits()
    size = F.coalesce(F.length("content"), F.lit(0)).cast("long")
    over = size > F.lit(limits.input_bytes) if limits.input_bytes is not None else F.lit(False)
    name = F.col(filename) if filename and filename in files.columns else F.lit(None).cast("string")
    # of files over the limit only the length is ever asked for
    routed = files.select("file_id", size.alias("size"), over.alias("over"), F.when(~over, F.coalesce("content", F.lit(bytearray()))).alias("content"), name.alias("name"))
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    routed = routed.withColumn("c", route.classify(F.col("content"), text, F.col("name"))).select("file_id", "size", "over", "content", F.when(~F.col("over"), F.col("c.route")).alias("route"), F.col("c.format").alias("format"))
    out = _read(routed, limits, password)
    if backend:
        images = routed.filter("route = 'image' AND NOT over").select("file_id", "content")
        out = out.join(image_pages(images, backend), "file_id", "left")
        read = F.col("confidence").isNotNull()
        page = F.struct(F.lit(1).alias("number"), F.coalesce("markdown", F.lit("")).alias("markdown"), F.when(read, "ocr").otherwise("unresolved").alias("origin"), F.col("confidence").alias("confidence"), F.coalesce("human_regions", F.lit(0)).cast("long").alias("human_regions"))
        failed = F.col("ocr_error").isNotNull()
        is_image = (F.col("route") == "image") & F.col("error").isNull()
        out = out.withColumns({
            "pages": F.when(is_image, F.when(~failed, F.array(page))).otherwise(F.col("pages")),
            "error": F.when(is_image & failed, _refused("ocr", F.concat(F.lit("OCR failed: "), "ocr_error"))).otherwise(F.col("error")),
            "elapsed_ms": F.col("elapsed_ms") + F.coalesce("ocr_ms", F.lit(0)),
        }).drop("markdown", "confidence", "human_regions", "ocr_error", "ocr_ms")
    allowed = F.lit(limits.input_bytes).cast("long")
    said = limit_message(F.lit("input size"), allowed.cast(CEILING), F.col("size").cast(CEILING))
    too_big = F.when(F.col("over"), _refused("too_large", F.concat(F.lit("refused: "), said), F.lit("input size"), allowed, F.col("size")))
    unresolved = _numbers(F.col("pages"), lambda p: p["origin"] == "unresolved")
    out = out.withColumn("unresolved_pages", unresolved)
    lacking = F.size("unresolved_pages").cast("long")
    need = F.when(F.lit(strict) & (lacking > 0), _refused("ocr_required", F.concat(lacking.cast("string"), F.lit(" page(s) need OCR and no OCR backend is configured")), pages=lacking))
    out = out.withColumn("error", F.coalesce(too_big, "error", need))
    ok = F.col("error").isNull()
    out = out.withColumns({"pages": F.when(ok, F.col("pages")), "unresolved_pages": F.when(ok, F.col("unresolved_pages"))})
    pages = F.col("pages")
    count = lambda o: F.size(F.filter(pages, lambda p: p["origin"] == o))
    marked = F.aggregate(pages, F.lit(0).cast("long"), lambda a, p: a + p["human_regions"])
    needing = F.coalesce(F.size("needing"), F.lit(0))
    kind = F.when((F.col("route") == "pdf") & F.col("needing").isNotNull(), route.pdf_kind(F.col("page_count"), needing))
    human = _numbers(pages, lambda p: p["human_regions"] > 0)
    return out.select(
        "file_id", "route", "format", kind.alias("kind"), F.when(F.col("route").isNotNull(), route.summary(F.col("route"), F.col("format"), F.col("page_count"), needing)).alias("summary"), "pages", "page_count",
        F.when(ok, _joined(pages, page_markers)).alias("markdown"), F.when(ok, _numbers(pages, lambda p: p["origin"] == "ocr")).alias("ocr_pages"), "unresolved_pages", F.when(ok, human).alias("human_pages"),
        F.when(ok, lacking == 0).alias("complete"), F.when(ok, F.size(human) > 0).alias("needs_a_person"),
        F.when(ok, F.concat(receipt(F.size(pages), count("text"), count("ocr"), count("unresolved"), marked), F.lit(", in "), F.col("elapsed_ms").cast("string"), F.lit("ms"))).alias("receipt"), "elapsed_ms", "error",
    )


def read_path(spark: SparkSession, path: str, *, limits: Limits | None = None, **options) -> DataFrame:
    """Documents of the files at a path; file_id is the file's path. Files are found by their directory
    listing; their bytes are read by the tasks that need them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return read_documents(found.select(F.col("path").alias("file_id"), "content", F.col("path").alias("filename")), limits=limits, **options)


def read(spark: SparkSession, content: bytes, *, filename: str | None = None, **options) -> dict:
    """One file's document as a dict: for a caller that has bytes in hand."""
    files = spark.createDataFrame([(0, bytearray(content), filename)], "file_id int, content binary, filename string")
    return read_documents(files, **options).first().asDict(recursive=True)


def to_markdown(spark: SparkSession, content: bytes, **options) -> str:
    got = read(spark, content, **options)
    if got["error"]:
        raise ValueError(got["error"]["message"])
    return got["markdown"]
