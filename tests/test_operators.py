"""Operators on small inputs with known answers, each with a control."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.functions import geometry
from pagewise.functions.text import sniff_delimited
from pagewise.limits import Limits, exceeded, message
from pagewise.operators import account, confidence, ctc, layout, markdown, route, vision
from pagewise.sources import archive, raster


def boxes(spark, rows, width=420.0):
    rows = [("f", 1, i, t, float(x), float(y), float(w), float(h), c, width) for i, (t, x, y, w, h, c) in enumerate(rows)]
    return spark.createDataFrame(rows, "file_id string, page int, box_idx int, text string, x double, y double, w double, h double, confidence double, page_width double")


def texts(spark, rows, **kw):
    return [r.text for r in layout.assemble(boxes(spark, [(*r, 0.9) for r in rows], **kw)).orderBy("line_no").collect()]


def test_one_row_and_two(spark):
    assert texts(spark, [("world", 60, 10, 50, 12), ("hello", 10, 11, 40, 12)]) == ["hello world"]
    assert texts(spark, [("one", 10, 10, 40, 12), ("two", 10, 40, 40, 12)]) == ["one", "two"]


def test_tall_box(spark):
    rows = [("Plums", 12, 50, 70, 28), ("3 kg", 210, 51, 40, 14), ("Pears", 12, 74, 66, 14), ("1 kg", 210, 75, 40, 14)]
    assert texts(spark, rows, width=0.0) == ["Plums 3 kg", "Pears 1 kg"]


@pytest.mark.parametrize("xs,w,n", [((10, 250), 150, 6), ((10, 160, 310), 80, 4)])
def test_columns(spark, xs, w, n):
    rows = [(f"{'ABC'[k]}{i}", x, 10 + 20 * i, w, 12) for i in range(n) for k, x in enumerate(xs)]
    assert texts(spark, rows) == [f"{'ABC'[k]}{i}" for k in range(len(xs)) for i in range(n)]


def test_markdown(spark):
    page = boxes(spark, [("Tide tables", 14, 6, 180, 30, 0.8), *[(f"high water {i}", 14, 90 + 22 * i, 120, 15, 0.95) for i in range(3)], ("see overleaf", 14, 320, 90, 15, 0.3)])
    got = markdown.to_markdown(layout.assemble(page)).first().markdown
    assert got == "# Tide tables\n\n\nhigh water 0\nhigh water 1\nhigh water 2\n\nsee overleaf <!-- low confidence -->\n"


def test_layout_exchanges_once_and_mends_broken_pages(spark):
    rows = [(f, 1, i, f"{f}{i}", 30.0 * (k % 5), 20.0 * (k // 3), 20.0, 12.0, 0.9, 420.0) for k, (f, i) in enumerate((f, i) for f in "abcd" for i in range(7))]
    b = spark.createDataFrame(rows, "file_id string, page int, box_idx int, text string, x double, y double, w double, h double, confidence double, page_width double")
    want = sorted(map(str, layout.assemble(b).collect()))
    for df in (layout.assemble(b), markdown.to_markdown(layout.pages_of(b)), markdown.heading_levels(layout.pages_of(b))):
        plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "ObjectHashAggregate" not in plan
    assert len(want) == 12 and markdown.to_markdown(layout.assemble(b)).count() == markdown.to_markdown(layout.pages_of(b)).count() == 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(str, layout.assemble(b).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_boxes(spark):
    nan, rows = float("nan"), [("a", None, 1, 5, 5, 0.5), ("b", 1, None, 5, 5, None), (None, 1, 40, 5, 5, 0.7), ("c", float("nan"), float("nan"), 5, None, float("nan"))]
    b = spark.createDataFrame([("f", 1, i, t, *[None if v is None else float(v) for v in (x, y, w, h, c)], nan) for i, (t, x, y, w, h, c) in enumerate(rows)], "file_id string, page int, box_idx int, text string, x double, y double, w double, h double, confidence double, page_width double")
    got = layout.assemble(b).collect()
    assert sorted((r.text, r.n_boxes, r.min_confidence) for r in got) == [("", 1, 0.7), ("a", 1, 0.5), ("b", 1, 0.0), ("c", 1, 0.0)]
    assert layout.group_into_lines(b).count() == 4 and layout.assemble(b.filter("false")).count() == 0


def test_confidence_steps_over_nan(spark):
    p = boxes(spark, [("a", 0, 0, 1, 1, float("nan")), ("b", 0, 0, 1, 1, 0.9), ("c", 0, 0, 1, 1, 0.4)])
    assert confidence.page_confidence(p, review_below=0.5).first().min_confidence == 0.4
    assert confidence.page_confidence(boxes(spark, [("a", 0, 0, 1, 1, float("nan"))]), review_below=0.5).first().min_confidence == 0.0


def test_ctc(spark):
    step = lambda k, v: [v if i == k else 0.01 for i in range(4)]
    rows = [(1, sum([step(1, 0.9), step(1, 0.8), step(0, 0.9), step(1, 0.7), step(2, 0.95)], [])), (2, []), (3, step(0, 0.9) * 3)]
    got = {r.id: (r.text, round(r.confidence, 4)) for r in ctc.decode_greedy(spark.createDataFrame(rows, "id int, probs array<double>"), 4, list("abc")).collect()}
    assert got == {1: ("aab", 0.85), 2: ("", 0.0), 3: ("", 0.0)}


@pytest.mark.parametrize("text,want", [("a,b,c\n1,2,3\n4,5,6\n7,8,9\n", ","), ('a,b,c\n1,"{""x"",2}",3\n4,"5,6",7\n', ","), ("a;b\n1;2\n3;4", ";"), ("a,b,c\n1,2,3\n", None), ("one, two\nthree\nfour, five, six\nseven", None), (None, None), ("", None)])
def test_sniff(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(sniff_delimited(F.col("t"))).first()[0] == want


def test_route(spark):
    rows = [(0, b"", None), (1, b"%PDF-1.7", None), (2, bytes.fromhex("89504E470D0A1A0A"), None), (3, b"tide\nebb 06:12\nflood 12:40\n", "x.csv"), (4, b"tide\nebb 06:12\nflood 12:40\n", None), (5, b"\0\0\0\x18ftypheic", None), (6, b"\0\0\0\x18ftypisom", None), (7, bytes.fromhex("FFD800010203"), "x.csv")]
    got = {r.id: (r.route, r.format) for r in route.inspect(spark.createDataFrame(rows, "id int, content binary, filename string")).collect()}
    assert got == {0: ("empty", None), 1: ("pdf", None), 2: ("image", "png"), 3: ("office", "csv"), 4: ("unknown", None), 5: ("image", "heic"), 6: ("unknown", None), 7: ("unknown", None)}


def test_route_of_packages_with_large_first_entries(spark):
    def package(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name in ("docProps/thumbnail.jpeg", *names):
                z.writestr(name, b"\xff" * 80000)
        return bytearray(out.getvalue())

    rows = [(0, package("word/document.xml", "a")), (1, package("xl/workbook.xml", "a")), (2, package("ppt/presentation.xml", "a")), (3, package("a", "b"))]
    got = {r.id: (r.route, r.format) for r in route.inspect(spark.createDataFrame([(*r, None) for r in rows], "id int, content binary, filename string")).collect()}
    assert got == {0: ("office", "docx"), 1: ("office", "xlsx"), 2: ("office", "pptx"), 3: ("unknown", None)}


def test_accounts_for_every_page(spark):
    pages = spark.createDataFrame([(1, 1, " a ", "text", 0), (1, 2, "", "unresolved", 0), (1, 3, "c", "ocr", 2)], "file_id int, number int, markdown string, origin string, human_regions long")
    r = account.roll_up(pages, markers=True, strict=True).first()
    assert r.markdown == "<!-- Page 1 -->\n\na\n\n<!-- Page 3 -->\n\nc" and r.error.pages == 1 and not r.complete and r.needs_a_person
    assert r.receipt == "3 page(s): 1 extracted, 1 recognised, 1 unresolved, 2 marked for a person"


def test_theil_sen_makes_its_arrays_once(spark):
    x, y = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i.cast("double")), F.col("v").cast("array<double>")
    given = spark.createDataFrame([([1.0, 3.0, 5.0, 7.0],), ([4.0, 4.0, 4.0, 90.0],)], "v array<float>")
    plan = given.select(vision.theil_sen(x, y).alias("l"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("sequence(0, 3") == 1 and plan.count("as array<double>") == 1
    got = given.select(vision.theil_sen(x, y).alias("l"), vision.theil_sen(F.slice(x, 1, 1), y).alias("none"))
    assert [(tuple(r.l), r.none) for r in got.collect()] == [((2.0, 1.0), None), ((pytest.approx(86 / 3), 4.0), None)]


def test_limits(spark):
    got = spark.range(1).select(exceeded("input size", 10, F.lit(11), F.lit(True)).alias("e")).select(message(F.col("e.limit"), F.col("e.allowed"), F.col("e.found"))).first()[0]
    assert got == "input size is 11, over the limit of 10"
    with pytest.raises(ValueError, match="unknown limit"):
        Limits.parse(page=3)
    assert Limits.none().pages is None


def test_geometry(spark):
    v = [F.lit(float(x)) for x in (1240, 1754, 595, 842)]
    p = geometry.pixels_to_points(F.lit(100.0), F.lit(50.0), F.lit(30.0), F.lit(20.0), *v)
    r = spark.range(1).select(p.alias("p")).select(geometry.points_to_pixels(F.col("p.x"), F.col("p.y"), F.col("p.w"), F.col("p.h"), *v).alias("q")).first().q
    assert np.allclose([r.x, r.y, r.w, r.h], [100, 50, 30, 20])


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def test_archive_guard(spark):
    low = Limits(archive_bytes=1 << 20, archive_entries=10, archive_depth=1)
    bomb = zipped(a=b"\0" * (8 << 20))
    assert archive.check(bomb, low)[0] == "declared decompressed bytes"
    lying = bytearray(bomb)
    for mark, at in ((b"PK\x03\x04", 22), (b"PK\x01\x02", 24)):  # sizes rewritten in both headers
        k = lying.index(mark)
        lying[k + at : k + at + 4] = (4096).to_bytes(4, "little")
    assert archive.check(bytes(lying), low)[0] == "decompressed bytes"
    assert archive.check(zipped(**{f"f{i}": b"x" for i in range(50)}), low)[0] == "archive entries"
    deep = zipped(b=zipped(c=zipped(d=b"x")))
    assert archive.check(deep, low)[0] == "archive nesting depth" and archive.check(deep, Limits()) is None
    assert archive.check(zipped(a=b"fine"), low) is None and archive.check(b"no zip", low) is None
    df = spark.createDataFrame([("a", bytearray(bomb)), ("b", bytearray(b"x"))], "path string, content binary")
    assert {r.path: r.exceeded and r.exceeded.limit for r in archive.check_files(df, low).collect()} == {"a": "declared decompressed bytes", "b": None}


def ruled(angle=0.0):
    img = np.full((240, 240), 255, np.uint8)
    for y in range(20, 220, 20):
        img[y : y + 6, 20:220] = 0
    return raster.rotate(img, angle) if angle else img


def test_raster_measures():
    assert abs(raster.estimate_skew(ruled(5)) - 5) <= 1.5
    assert raster.estimate_skew(np.full((200, 200), 255, np.uint8)) == 0.0
    assert raster.detect_orientation(ruled()) == 0 and raster.detect_orientation(np.rot90(ruled())) == 90
    half = np.full((10, 10), 20, np.uint8)
    half[:, 5:] = 220
    assert 20 <= raster.otsu_level(half) < 220
    png = raster.encode_png(half)
    assert (raster.decode(png) == half).all() and raster.header_size(png) == (10, 10)
    with pytest.raises(raster.TooLarge):
        raster.decode(png, Limits(pixels_per_page=50))
