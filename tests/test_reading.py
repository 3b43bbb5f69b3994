"""Reading files: odd and hostile ones, the order of refusals, the command line, arriving files."""

import bz2
import io
import json
import tracemalloc
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from pagewise import __main__ as cli
from pagewise import models
from pagewise.limits import Limits
from pagewise.operators import read, route
from pagewise.plans import reading, samples
from pagewise.sources import archive, office, pdf
from pagewise.streaming import ingest


def files(spark, *contents):
    return spark.createDataFrame([(k, None if c is None else bytearray(c), n) for k, (c, n) in enumerate(contents)], "file_id int, content binary, filename string")


def test_first_refusal_counts(spark):
    deep = samples.package({"a": samples.package({"b": samples.package({"c": samples.package({"d": "x"})})})})
    given = files(
        spark, (b"", None), (None, None), (b"x" * 60_000, None), (deep + b" " * 60_000, None), (deep, None), (samples.pdf([["a"]] * 9), None), (b"%PDF-1.4 nothing", None), (b"no format at all", None),
        (samples.pdf([["a"], None]), None), (samples.docx(["fine"]), None), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + "Workbook".encode("utf-16-le"), None), (b"PK\x03\x04word/", "a.docx"), (b"just text", "notes.csv"),
    )
    got = {r.file_id: r for r in read.read_documents(given, limits=Limits(input_bytes=50_000, pages=5), strict=True).collect()}
    assert len(got) == 13
    kinds = [got[k].error.kind if got[k].error else None for k in range(13)]
    assert kinds == ["unsupported", "unsupported", "too_large", "too_large", "too_large", "too_large", "pdf", "unsupported", "ocr_required", None, "document", "document", None]
    assert [got[k].error.limit for k in (2, 3, 4, 5)] == ["input size", "input size", "archive nesting depth", "pages"] and got[5].error.found == 9
    assert got[8].error.pages == 1 and got[8].markdown is None and got[9].markdown == "fine" and got[10].format == "xls" and got[12].markdown == "| just text |\n| --- |"
    assert got[9].complete and got[9].receipt.startswith("1 page(s): 1 extracted, 0 recognised, 0 unresolved, 0 marked for a person, in ")


def test_read_one_file(spark):
    assert read.to_markdown(spark, samples.odt("T", ["a & b", "<c>"])) == "## T\n\na & b\n\n<c>"
    with pytest.raises(ValueError, match="unrecognised"):
        read.to_markdown(spark, b"?")
    got = read.read(spark, samples.pdf([["one"], None, ["two"]]), page_markers=True)
    assert got["markdown"] == "<!-- Page 1 -->\n\none\n\n<!-- Page 3 -->\n\ntwo" and got["unresolved_pages"] == [2] and got["kind"] == "mixed" and got["summary"] == "mixed PDF, 3 pages, 1 need OCR"


def test_lines_keep_digits_that_equal_their_number(spark):
    text = "0 ends in 0\n  1 ends in 1 \n\n 3 ends in 3\n+4"
    assert spark.createDataFrame([(text,)], "t string").select(reading._parts(F.col("t"))).first()[0] == ["0 ends in 0", "1 ends in 1", "3 ends in 3", "+4"]


def test_what_parts_hold_is_not_their_name(spark):
    def stored(**parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in parts.items():
                z.writestr(name.replace("__", "/"), body)
        return out.getvalue()

    deck = stored(ppt__a=b"xl/ word/" + samples.xlsx([("S", [["a"]])]), ppt__presentation=b"PK\x05\x06")
    given = files(spark, (deck, None), (deck[:-30], None), (deck[: -len("ppt/presentation") - 60] + b"?", None), (stored(a=samples.docx(["x"])), None), (b"\0" * 9 + deck, None), (samples.docx(["x"] * 9000), None), (b"PK\x03\x04", None))
    got = {r.file_id: r.format for r in route.inspect(given).collect()}
    assert got[0] == "pptx" and got[3] is None and got[4] is None and got[5] == "docx" and got[6] is None
    assert got[1] == "xlsx"  # cut short: the package inside is all that tells


def test_rows_of_delimited_text_arent_kept():
    content = "\n".join(f"{k};name {k};segment" for k in range(30_000)).encode()
    tracemalloc.start()
    try:
        assert office.to_markdown(content, "csv").count("\n") == 30_000
        assert tracemalloc.get_traced_memory()[1] < 12 * len(content)
    finally:
        tracemalloc.stop()


def test_files_leave_as_they_are_made(spark):
    rows = spark.createDataFrame([(k, ["x" * 600_000, "y"]) for k in range(4)], "file_id long, parts array<string>").coalesce(1)
    made = reading.made(rows, lambda parts: (next(parts) + str(len(list(parts)))).encode(), "a.txt")
    sizes = made.mapInArrow(lambda bs: (type(b).from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert [(r.file_id, len(r.content)) for r in made.orderBy("file_id").collect()] == [(k, 600_001) for k in range(4)] and sum(r.n for r in sizes.collect()) == 4


def test_office_structure():
    w = samples.W
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading2"/><w:tabs><w:tab w:val="left"/></w:tabs></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>'
        '<w:p><w:pPr><w:numPr/></w:pPr><w:r><w:t>item</w:t><w:tab/><w:t>more</w:t></w:r></w:p><w:sdt><w:sdtContent><w:p><w:r><w:t>inside</w:t></w:r></w:p></w:sdtContent></w:sdt>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc/></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>"
    )
    content = samples.package({"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    assert office.to_markdown(content, "docx") == "## Head\n\n- item\tmore\n\ninside\n\n| a\\|b |  |\n| --- | --- |\n| c |  |"
    assert office.to_markdown(samples.opendocument("text", "<text:list><text:list-item><text:p>x<text:s text:c=\"3\"/>y</text:p></text:list-item></text:list>"), "odt") == "- x   y"
    assert office.to_markdown(b"{\\rtf1\\ansi\\ansicpg1252 caf\\'e9 \\u8364? {\\*\\x no}{\\info{\\title no}}\\b bold\\b0\\par \\{z\\}}", "rtf") == "café € bold\n\n{z}"
    assert office.to_markdown('a;"b;\n1";c\nd;e;f\n'.encode("utf-8-sig"), "csv") == "| a | b; 1 | c |\n| --- | --- | --- |\n| d | e | f |"


@pytest.mark.parametrize("content, fmt", [
    (b"PK\x03\x04 damaged", "docx"), (samples.package({"a": "b"}), "docx"), (samples.package({"word/document.xml": "<a><b></a>"}), "docx"), (b"plain", "rtf"), (b"x", "doc"),
    (samples.package({"word/document.xml": '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'}), "docx"), (samples.package({"content.xml": "<a>" * 100_000}), "odt"), (samples.package({"META-INF/container.xml": "<a/>"}), "epub"),
])
def test_office_refuses(content, fmt):
    with pytest.raises(office.Unreadable):
        office.to_markdown(content, fmt)


def test_office_stays_within_limits():
    with pytest.raises(office.Unreadable, match="unpacks to more"):
        office.to_markdown(samples.docx(["x" * 100_000]), "docx", Limits(archive_bytes=50_000))


def test_archive_unpacks_other_methods_within_the_ceiling():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("a", b"\0" * (4 << 20))
    raw = bytearray(out.getvalue())
    for mark, at in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):
        k = raw.index(mark)
        raw[k + at : k + at + 4] = (10).to_bytes(4, "little")
    assert archive.check(bytes(raw), Limits(archive_bytes=1 << 20)) == ("decompressed bytes", 1 << 20, None)
    assert len(bz2.compress(b"\0" * (4 << 20))) < 1000


def texts(content, **kw):
    return [(p.markdown, p.needs_ocr) for p in pdf.page_texts(pdf.Pdf(content, **kw))]


def test_pdf_pages():
    assert texts(samples.pdf([["(a) \\ b", "second  line"], None, []])) == [("(a) \\ b\nsecond line", False), ("", True), ("", False)]
    twin = samples.pdf([["secret words"], ["more"]], password="")
    assert texts(twin) == texts(samples.pdf([["secret words"], ["more"]])) and b"secret" not in twin
    for password, error in ((None, pdf.PasswordRequired), ("no", pdf.PasswordRejected)):
        with pytest.raises(error):
            pdf.Pdf(samples.pdf([["x"]], password="yes"), password=password)
    assert texts(samples.pdf([["x"]], password="yes"), password="yes") == [("x", False)]


def test_pdf_object_streams_and_unicode_maps():
    cmap = b"1 beginbfchar <0001> <0048> endbfchar 1 beginbfrange <0002> <0003> <0069> endbfrange 1 beginbfrange <0010> <0011> [<00660066> <20AC>] endbfrange"
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R 8 0 R]/Count 2>>", b"<</Type/Page/Contents 6 0 R/Resources<</Font<</F 4 0 R>>>>>>", b"<</Type/Font/Subtype/Type0/ToUnicode 7 0 R>>", b"<</Type/Page/Contents 6 0 R/Resources<</Font<</F 9 0 R>>>>>>", b"<</Type/Font/Subtype/Type0>>"]
    numbers, at, body = [1, 2, 3, 4, 8, 9], [], b""
    for x in inner:
        at.append(len(body))
        body += x + b" "
    head = b" ".join(b"%d %d" % p for p in zip(numbers, at, strict=True)) + b" "
    packed = zlib.compress(head + body)
    said = b"BT /F 10 Tf 1 0 0 1 0 0 Tm <0001000200030010> Tj [<0011> -2000 <0001>] TJ ET"
    content = b"%%PDF-1.5\n5 0 obj <</Type/ObjStm/N 6/First %d/Filter/FlateDecode/Length %d>> stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    content += b"6 0 obj <</Length 99999>> stream\n%s\nendstream endobj 7 0 obj <</Length %d>> stream\n%s\nendstream endobj" % (said, len(cmap), cmap)
    assert texts(content) == [("Hijff€ H", False), ("", True)]  # a wrong length; no map for the second page's font


@pytest.mark.parametrize("content", [b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj <</Type/Catalog/Pages 1 0 R>> endobj", b"%PDF-1.4 1 0 obj " + b"[" * 5000, samples.pdf([["a"]])[:300]])
def test_damaged_pdfs_end(content):
    try:
        assert isinstance(texts(content), list)
    except pdf.PdfError:
        pass


def test_survey(spark):
    plans = {r.file_id: r for r in route.inspect(files(spark, (samples.pdf([["a"], None]), None), (b"a,b\n1,2\n3,4\n5,6", None), (b"%PDF-1.1 broken", None)), survey=True).collect()}
    assert (plans[0].kind, plans[0].needs_ocr, plans[0].ocr_page_count, plans[0].needing) == ("mixed", True, 1, [2])
    assert plans[1].summary == "Csv document, no OCR needed" and not plans[1].needs_ocr and plans[2].error


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(samples.docx(["words"]))
    (tmp_path / "in/b.pdf").write_bytes(samples.pdf([["page one"], None]))
    return tmp_path


def test_command_line(spark, folder, capsys):
    at = str(folder / "in")
    assert cli.main([], spark) == 2 and cli.main(["--what", at], spark) == 2 and cli.main(["-o"], spark) == 2 and cli.main(["-h"], spark) == 0
    capsys.readouterr()
    assert cli.main([at], spark) == 3
    assert sorted(capsys.readouterr().out.split("\n")) == ["", "page one", "words"]
    assert cli.main(["--inspect", at + "/b.pdf"], spark) == 0 and "mixed PDF, 2 pages, 1 need OCR" in capsys.readouterr().out
    assert cli.main(["--strict", "--json", at], spark) == 1
    rows = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert sorted((r["error"] or {}).get("kind") or "" for r in rows) == ["", "ocr_required"]
    assert cli.main(["--json", "--pages", "-o", str(folder / "out"), at + "/a.docx"], spark) == 0 and spark.read.json(str(folder / "out")).count() == 1
    assert cli.main([at + "/missing"], spark) == 1


def test_stream(spark, folder):
    q = ingest.stream_plans(spark, str(folder / "in")).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(folder / "cp")).start()
    q.awaitTermination(60)
    assert sorted(r.route for r in spark.table("arrived").collect()) == ["office", "pdf"]
    q = ingest.stream_documents(spark, str(folder / "in")).writeStream.format("memory").queryName("read").trigger(availableNow=True).option("checkpointLocation", str(folder / "cp2")).start()
    q.awaitTermination(60)
    assert sorted(r.markdown for r in spark.table("read").collect()) == ["page one", "words"]


def test_read_path(spark, folder):
    got = read.read_path(spark, str(folder / "in"))
    assert {r.file_id.rpartition("/")[2]: r.markdown for r in got.collect()} == {"a.docx": "words", "b.pdf": "page one"}
    assert got.filter(F.col("complete")).count() == 1


def test_models(tmp_path, monkeypatch):
    monkeypatch.setenv("PAGEWISE_HOME", str(tmp_path))
    spec = models.ModelSpec("m.bin", models.digest(b"weights"))
    with pytest.raises(models.ModelMissing):
        models.resolve(spec)
    models.model_path(spec).write_bytes(b"weights")
    assert models.resolve(spec) == tmp_path / "m.bin"
    models.model_path(spec).write_bytes(b"other")
    with pytest.raises(models.ModelCorrupt):
        models.resolve(spec)
    monkeypatch.delenv("PAGEWISE_HOME")
    monkeypatch.setenv("XDG_CACHE_HOME", "/x")
    assert str(models.cache_dir()) == "/x/pagewise"
