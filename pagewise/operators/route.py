"""Routing: what a file is, and what reading it would cost. One projection, no readers run."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, sniff_delimited
from ..limits import Limits
from ..sources import pdf

#: Extensions of the office formats, by which a name can be a hint.
OFFICE = ("doc", "docx", "docm", "ppt", "pps", "pot", "pptx", "pptm", "ppsx", "ppsm", "xls", "xlsx", "xlsm", "xlsb", "odt", "ods", "odp", "rtf", "epub", "csv")
HEIC = ("heic", "heix", "heim", "heis", "hevc", "hevx", "hevm", "hevs")


def head(content: Column, start: int | Column, n: int | Column) -> Column:
    """Bytes as upper-case hex."""
    return F.hex(F.substring(content, start, n))


def heif_brand(content: Column) -> Column:
    brand = head(content, 9, 4)
    code = lambda s: s.encode().hex().upper()
    kind = F.when(brand.isin([code(x) for x in HEIC]), "HEIC").when(brand.isin(code("avif"), code("avis")), "AVIF").when(brand.isin(code("mif1"), code("msf1"), code("mif2")), "HEIF")
    return F.when(head(content, 5, 4) == code("ftyp"), kind)


def image_kind(content: Column) -> Column:
    """The image format of magic bytes, else null."""
    h = head(content, 1, 12)
    return (
        F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("424D"), "bmp").when(h.startswith("49492A00") | h.startswith("4D4D002A"), "tiff")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").otherwise(F.lower(heif_brand(content)))
    )


def png_size(content: Column) -> Column:
    """(width, height) from a PNG's header, before any pixel is decoded."""
    number = lambda at: F.conv(head(content, at, 4), 16, 10).cast("long")
    return F.when(image_kind(content) == "png", F.struct(number(17).alias("width"), number(21).alias("height")))


def _directory(content: Column) -> Column:
    """The central directory of a zip as text, null where its end isn't found. It names the parts, and has
    nothing of what they hold."""
    text = lambda c: F.decode(c, "ISO-8859-1")
    tail = F.substring(content, -65557, 65557)  # the end record and the longest comment
    before = F.length(F.regexp_extract(text(tail), r"(?s)^(.*)PK\x05\x06.{18}", 1))

    def cut(end: Column) -> Column:
        size = F.conv(F.concat(*[head(content, end + k, F.lit(1)) for k in (16, 15, 14, 13)]), 16, 10).cast("long")
        found = (head(content, end + 1, F.lit(4)) == "504B0506") & (size <= end) & (head(content, (end - size + 1).cast("int"), F.lit(4)) == "504B0102")
        return F.when(found, text(F.substring(content, (end - size + 1).cast("int"), size.cast("int"))))

    return bound(F.length(content) - F.length(tail) + before, cut)


def office_kind(content: Column) -> Column:
    """Office format by magic: zip packages by the names of their parts, OLE2, RTF."""
    h = head(content, 1, 8)
    parts = F.decode(F.substring(content, 1, 1 << 16), "ISO-8859-1")

    def by_names(listed: Column) -> Column:
        # a zip cut short has no directory, but a header before each part
        has = lambda folder: F.when(listed.isNotNull(), listed.rlike(rf"(?s)PK\x01\x02.{{42}}{folder}")).otherwise(F.decode(content, "ISO-8859-1").rlike(rf"(?s)PK\x03\x04.{{26}}{folder}"))
        return F.when(has("word/"), "docx").when(has("xl/"), "xlsx").when(has("ppt/"), "pptx")

    zipped = (
        F.when(parts.contains("mimetypeapplication/epub+zip"), "epub").when(parts.contains("mimetypeapplication/vnd.oasis.opendocument.text"), "odt")
        .when(parts.contains("mimetypeapplication/vnd.oasis.opendocument.spreadsheet"), "ods").when(parts.contains("mimetypeapplication/vnd.oasis.opendocument.presentation"), "odp")
        .otherwise(bound(_directory(content), by_names))
    )
    # OLE2 files name their streams in UTF-16
    inside = lambda name: F.contains(content, F.lit(bytearray(name.encode("utf-16-le"))))
    old = F.when(inside("WordDocument"), "doc").when(inside("PowerPoint Document"), "ppt").when(inside("Workbook") | inside("Book"), "xls").otherwise("doc")
    return F.when(h.startswith("504B0304"), zipped).when(h == "D0CF11E0A1B11AE1", old).when(h.startswith("7B5C727466"), "rtf")


def classify(content: Column, text: Column, filename: Column) -> Column:
    """(route, format) in the order: empty, office and PDF magic, image magic, delimited text, name, unknown.

    text: the content as text if it is valid UTF-8, else null.
    """
    suffix = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    row = lambda route, fmt: F.struct(F.lit(route).alias("route"), fmt.alias("format"))
    none = F.lit(None).cast("string")
    is_csv = sniff_delimited(text).isNotNull()
    by_magic = bound(F.struct(office_kind(content).alias("office"), image_kind(content).alias("image")), lambda k: F.when(k["office"].isNotNull(), row("office", k["office"])).when(head(content, 1, 5) == "255044462D", row("pdf", none)).when(k["image"].isNotNull(), row("image", k["image"])))
    by_text = F.when(is_csv, row("office", F.lit("csv"))).when(text.isNotNull() & suffix.isin(*OFFICE), row("office", suffix)).otherwise(row("unknown", none))
    return F.when(F.length(content) == 0, row("empty", none)).otherwise(F.coalesce(by_magic, by_text))


def pdf_kind(page_count: Column, needing: Column) -> Column:
    """Text, mixed or scanned, from the pages and how many of them need OCR."""
    return F.when(needing == 0, "text").when(needing >= page_count, "scanned").otherwise("mixed")


def summary(route: Column, fmt: Column, page_count: Column, needing: Column) -> Column:
    n, k = page_count.cast("string"), needing.cast("string")
    kind = pdf_kind(page_count, needing)
    pdf = F.when(kind == "text", F.concat(F.lit("text PDF, "), n, F.lit(" pages, no OCR needed"))).when(kind == "mixed", F.concat(F.lit("mixed PDF, "), n, F.lit(" pages, "), k, F.lit(" need OCR"))).otherwise(F.concat(F.lit("scanned PDF, all "), n, F.lit(" pages need OCR")))
    return F.when(route == "office", F.concat(F.initcap(fmt), F.lit(" document, no OCR needed"))).when(route == "pdf", pdf).when(route == "image", "image, needs OCR").otherwise("unrecognised")


def inspect(files: DataFrame, filename: str | None = "filename", *, survey: bool = False, limits: Limits | None = None) -> DataFrame:
    """files (content) to plans: route, format, needs_ocr, ocr_page_count. With survey, the pages of PDFs are
    looked at as well, which adds page_count, kind, error and the summary, and needs Python for PDFs."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    name = F.col(filename) if filename and filename in files.columns else F.lit(None).cast("string")
    out = files.withColumn("_c", classify(F.col("content"), text, name))
    own = [c for c in files.columns if c != "content"]
    if not survey:
        return out.select(*own, F.col("_c.route").alias("route"), F.col("_c.format").alias("format"), (F.col("_c.route") == "image").alias("needs_ocr"), (F.col("_c.route") == "image").cast("int").alias("ocr_page_count"))
    # only the bytes of PDFs leave the JVM
    seen = survey_pdfs(out.withColumn("content", F.when(F.col("_c.route") == "pdf", F.col("content"))).select(*own, "_c.*", "content"), limits)
    pages, needing = F.coalesce("page_count", F.lit(0)), F.coalesce(F.size("needing"), F.lit(0))
    is_pdf = F.col("route") == "pdf"
    count = F.when(is_pdf, needing).otherwise((F.col("route") == "image").cast("int"))
    kind = F.when(is_pdf & F.col("error").isNull(), pdf_kind(pages, needing))
    return seen.select(*own, "route", "format", (count > 0).alias("needs_ocr"), count.cast("int").alias("ocr_page_count"), "page_count", kind.alias("kind"), "needing", summary(F.col("route"), F.col("format"), pages, needing).alias("summary"), "error")


_SURVEY = {"page_count": pa.int32(), "needing": pa.list_(pa.int32()), "error": pa.string()}


def survey_pdfs(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """files (content, null where there is nothing to look at) without content, plus page_count, the numbers
    of the pages that need OCR, and error."""

    def one(content) -> tuple:
        if content is None:
            return None, None, None
        try:
            found = list(pdf.page_texts(pdf.Pdf(bytes(content), limits)))
        except pdf.PdfError as e:
            return None, None, str(e)
        return len(found), [p.number for p in found if p.needs_ocr], None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("content")
            rows = [one(x.as_py()) for x in batch.column(at)]
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for n in batch.schema.names if n != "content"]
            cols = zip(*rows, strict=True) if rows else [[] for _ in _SURVEY]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(cols, _SURVEY.values(), strict=True)]], names=[*names, *_SURVEY])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    return files.mapInArrow(run, f"{ddl}, page_count int, needing array<int>, error string")
