"""The engine and its measures, with stub models, against plain loops."""

from dataclasses import dataclass, replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewise.limits import Limits
from pagewise.ocr import engine, frame, human
from pagewise.operators import layout, markdown, read, scan
from pagewise.sources import raster


def test_png_filters():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 7, 3)).astype(np.uint8)
    flat = img.reshape(9, 21).astype(int)
    rows = []
    for y in range(9):
        kind, line, up = y % 5, flat[y], flat[y - 1] if y else np.zeros(21, int)
        a = np.concatenate([np.zeros(3, int), line[:-3]])
        c = np.concatenate([np.zeros(3, int), up[:-3]])
        p = a + up - c
        paeth = np.where((abs(p - a) <= abs(p - up)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - up) <= abs(p - c), up, c))
        rows.append(bytes([kind]) + ((line - [0, a, up, (a + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
    assert (raster._unfilter(b"".join(rows), 9, 21, 3).reshape(9, 7, 3) == img).all()


@dataclass
class Other:
    size: int = 8

    def handles(self, content):
        return content[:4] == b"ELSE"

    def decode(self, content):
        return np.full((self.size, self.size), 9, np.uint8)


def test_decoding_falls_back_only_where_nothing_else_is():
    assert raster.decode_using(b"ELSE", decoder=Other()).shape == (8, 8)
    png = raster.encode_png(np.zeros((4, 4), np.uint8))
    for content, error in ((b"ELS?", "no decoder"), (b"\0\0\0\x18ftypheic", "HEIC"), (png[:45], "damaged")):
        with pytest.raises(raster.Undecodable, match=error):
            raster.decode_using(content, decoder=Other())
    with pytest.raises(raster.TooLarge):
        raster.decode_using(b"ELSE", Limits(pixels_per_page=50), Other())


def slow_chamfer(mask):
    d = np.where(mask, 65535, 0).astype(int)
    h, w = mask.shape
    for order, near in ((range(h * w), ((0, -1, 3), (-1, -1, 4), (-1, 0, 3), (-1, 1, 4))), (range(h * w - 1, -1, -1), ((0, 1, 3), (1, 1, 4), (1, 0, 3), (1, -1, 4)))):
        for i in order:
            y, x = divmod(i, w)
            for dy, dx, cost in near:
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    d[y, x] = min(d[y, x], min(65535, d[y + dy, x + dx] + cost))
    return d


def test_chamfer_and_ridges():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.75
        d = slow_chamfer(mask)
        assert (human.chamfer(mask) == d).all()
        ridge = [d[y, x] for y in range(d.shape[0]) for x in range(d.shape[1]) if d[y, x] and d[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max() <= d[y, x]]
        assert sorted(human.stroke_samples(mask).tolist()) == sorted(min(v * 20, 65535) // 3 for v in ridge)


def test_theil_sen_bears_outliers():
    x = np.arange(300, dtype=np.float32)
    y = 0.5 * x + 3
    y[::10] += 90
    slope, intercept = human.theil_sen(x, y)
    assert abs(slope - 0.5) < 1e-3 and abs(intercept - 3) < 1e-2 and human.theil_sen(x[:1], y[:1]) is None


def strokes(widths, drift=0.0):
    """Upright strokes of given widths whose feet stray by up to `drift` pixels."""
    img = np.full((60, sum(widths) + 6 * len(widths) + 6), 255, np.uint8)
    x = 4
    for k, w in enumerate(widths):
        img[10 : 50 - int(drift * (k * 7 % 5) / 4), x : x + w] = 0
        x += w + 6
    return img


def test_handwriting_measures():
    print_, pen = human.measure(strokes([4] * 20)), human.measure(strokes([1, 2, 9, 1, 12, 3] * 4, drift=12))
    assert print_.baseline_drift == 0 and print_.stroke_variation < 0.8 and not human.judge(print_, human.Floors())
    assert pen.stroke_variation >= 0.8 and pen.baseline_drift >= 0.08 and human.judge(pen, human.Floors()) and not human.judge(pen, human.Floors.never())
    assert human.measure(np.full((9, 50), 0, np.uint8)) is None and human.measure(np.full((40, 40), 255, np.uint8)) is None and not human.judge(None, human.Floors())
    assert human.page_reference([0.9, float("nan"), 0.1, 0.5]) == 0.5 and human.page_reference([]) == 0.0


def page_on_desk(h=600, w=800):
    img = np.full((h, w), 90, np.uint8)
    rng = np.random.default_rng(3)
    img[150:450, 200:560] = rng.choice(np.array([20, 240], np.uint8), (300, 360))
    img[20:30, 20:30] = 255
    return img


def test_content_bounds():
    x, y, w, h = frame.content_bounds(page_on_desk())
    assert abs(x - 184) <= 8 and abs(y - 134) <= 8 and abs(x + w - 576) <= 8 and abs(y + h - 466) <= 10
    big = frame.content_bounds(np.kron(page_on_desk(), np.ones((2, 2), np.uint8)))
    assert all(abs(a - 2 * b) <= 20 for a, b in zip(big, (x, y, w, h), strict=True))
    assert frame.content_bounds(np.full((300, 300), 7, np.uint8)) is None and frame.content_bounds(np.zeros((20, 300), np.uint8)) is None
    assert frame.content_bounds(np.random.default_rng(1).choice(np.array([0, 255], np.uint8), (300, 300))) is None  # it fills the image
    assert frame.largest_group(np.array([[1, 0, 1], [0, 0, 1]], bool)).tolist() == [[False, False, True], [False, False, True]]


@pytest.mark.parametrize("rotation, skew", [(0, 0.0), (90, 0.0), (180, 0.0), (270, 0.0), (0, 7.0), (90, -4.0)])
def test_correction_leads_back(rotation, skew):
    img = np.full((200, 300), 255, np.uint8)
    img[60:70, 210:220] = 0
    turned = raster.turned(img, rotation)
    straight = raster.rotate(turned, -skew)
    c = engine.Correction(rotation, skew, img.shape[::-1], turned.shape[::-1], (5, 6))
    y, x = (v.mean() for v in np.nonzero(straight < 128))
    ox, oy = c.to_original(x, y)
    assert abs(ox - 214.5) <= 1.5 and abs(oy - 64.5) <= 1.5 and np.allclose(c.to_frame(x, y), (ox + 5, oy + 6)) and c.is_identity() == (not rotation and not skew)
    quad = tuple((x + dx, y + dy) for dx, dy in ((-4, -4), (4, -4), (4, 4), (-4, 4)))
    assert engine.crop(engine.Prepared(straight, img, c), quad).mean() < 60


class Whole:
    def detect(self, image):
        h, w = image.shape
        return [((0, 0), (w, 0), (w, h), (0, h))]


@dataclass
class ByShape:
    """Reads what lies across well, and what stands upright badly."""

    seen: list

    def recognize(self, crop):
        wide = crop.shape[1] > crop.shape[0]
        self.seen.append(crop.shape)
        return ("well read", 0.9) if wide else ("x", 0.2)

    def recognize_batch(self, crops):
        return [self.recognize(c) for c in crops]


def test_ladder_turns_until_it_is_sure():
    tall = raster.encode_png(np.random.default_rng(4).integers(0, 256, (120, 60)).astype(np.uint8))
    plain = replace(engine.ScanOptions(), flatten_lighting=False, crop_to_content=False, fix_skew=False)
    reads = ByShape([])
    got = engine.Engine(Whole(), reads, plain).scan_bytes(tall)
    assert (got.rotation, got.boxes[0].text, got.confidence) == (90, "well read", 0.9) and len(reads.seen) == 2
    once = ByShape([])
    assert engine.Engine(Whole(), once, replace(plain, retry_when_unsure=False)).scan_bytes(tall).rotation == 0 and len(once.seen) == 1
    fixed = ByShape([])
    assert engine.Engine(Whole(), fixed, replace(plain, fix_orientation=False)).scan_bytes(tall).boxes[0].text == "x" and len(fixed.seen) == 1
    with pytest.raises(ValueError, match="unknown profile"):
        engine.profile("scan")


@dataclass
class Two:
    """Print on the left, handwriting on the right."""

    def detect(self, image):
        h, w = image.shape
        half = w // 2
        return [((0, 0), (half, 0), (half, h), (0, h)), ((half, 0), (w, 0), (w, h), (half, h))]


class Says:
    def recognize_batch(self, crops):
        return [(f"t{k}", 0.8) for k in range(len(crops))]


def test_handwriting_isnt_read(spark):
    left, right = strokes([4] * 20), strokes([1, 2, 9, 1, 12, 3] * 4, drift=12)
    w = max(left.shape[1], right.shape[1])
    img = np.hstack([np.pad(x, ((0, 0), (0, w - x.shape[1])), constant_values=255) for x in (left, right)])
    files = spark.createDataFrame([(1, bytearray(raster.encode_png(img)), "a.png"), (2, bytearray(raster.encode_png(img)[:45]), None), (3, bytearray(b"\xff\xd8\xff\xe0 jpeg"), None)], "file_id int, content binary, filename string")
    backend = engine.Engine(Two(), Says(), engine.profile("rendered_page"))
    got = {r.file_id: r for r in read.read_documents(files, backend=backend).collect()}
    assert got[1].markdown == "t0 [handwritten]" and got[1].human_pages == [1] and got[1].needs_a_person and got[1].ocr_pages == [1]
    assert [got[k].error.kind for k in (2, 3)] == ["ocr", "ocr"]
    assert {r.file_id: r.unresolved_pages for r in read.read_documents(files.filter("file_id = 1")).collect()} == {1: [1]}
    regions = scan.regions_of(scan.scan_images(files.select("file_id", "content"), backend)).collect()
    assert len(regions) == 1 and regions[0].stroke_variation >= 0.8 and regions[0].page_confidence == 0.8


def test_prepare_tells_the_way_back(spark):
    files = spark.createDataFrame([("a", bytearray(raster.encode_png(page_on_desk()))), ("b", bytearray(b"?")), ("c", None)], "path string, content binary")
    got = {r.path: r for r in scan.prepare_images(files).collect()}
    assert got["a"].crop_x > 150 and got["a"].original_width < 500 and len(got["a"].pixels) == got["a"].width * got["a"].height
    assert got["b"].error and got["c"].error and got["b"].pixels is None
    with pytest.raises(ValueError, match="unknown profile"):
        scan.prepare_images(files, profile="x")
    assert scan.prepare_images(files.filter("path = 'a'"), options=engine.ScanOptions(turn=90, crop_to_content=False, fix_skew=False)).first().rotation == 90


def test_image_files(spark, tmp_path):
    img = np.arange(48, dtype=np.uint8).reshape(6, 8) * 5
    (tmp_path / "a.png").write_bytes(raster.encode_png(img))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.path.rpartition("/")[2]: r for r in scan.read_image_files(spark, str(tmp_path)).collect()}
    assert got["a.png"].pixels == img.tobytes() and (got["a.png"].width, got["a.png"].height) == (8, 6) and got["b.png"].pixels is None


def test_lines_with_handwriting(spark):
    boxes = [(0, "left", 10.0, 100.0, 40.0, 12.0), (1, "right", 200.0, 101.0, 40.0, 12.0), (2, "below", 10.0, 300.0, 40.0, 12.0)]
    b = spark.createDataFrame([("f", 1, *r, 0.9, 0.0) for r in boxes], "file_id string, page int, box_idx int, text string, x double, y double, w double, h double, confidence double, page_width double")
    regions = [(0, 100.0, 102.0, 30.0, 10.0), (1, 5.0, 220.0, 30.0, 10.0), (2, 5.0, 180.0, 30.0, 10.0), (3, 5.0, 400.0, 30.0, 10.0), (4, 5.0, 220.0, 30.0, 10.0)]
    r = spark.createDataFrame([("f", 1, *x) for x in regions] + [("empty", 1, 0, 1.0, 1.0, 2.0, 2.0)], "file_id string, page int, region_idx int, x double, y double, w double, h double")
    lines = layout.lines_with_human(layout.group_into_lines(layout.split_columns(b)), r)
    got = [(x.text, x.n_human, round(x.baseline_y)) for x in lines.filter("file_id = 'f'").orderBy("line_no").collect()]
    assert got == [("left [handwritten] right", 1, 106), ("[handwritten]", 1, 185), ("[handwritten]", 1, 225), ("[handwritten]", 1, 225), ("below", 0, 306), ("[handwritten]", 1, 405)]
    assert lines.filter(F.col("file_id") == "empty").first().text == "[handwritten]"
    assert "[handwritten] <!-- low confidence -->" in markdown.to_markdown(lines).filter("file_id = 'f'").first().markdown


def test_handwriting_comes_to_its_page_by_one_exchange(spark):
    b = spark.createDataFrame([("f", 1, 0, None, None, 10.0, 5.0, 12.0, None, None), ("f", 1, 1, "a", 50.0, 10.0, 5.0, 12.0, 0.9, None)], "file_id string, page int, box_idx int, text string, x double, y double, w double, h double, confidence double, page_width double")
    r = spark.createDataFrame([("f", 1, 0, 20.0, 11.0, 3.0, 10.0), ("f", 1, 1, 70.0, 11.0, 3.0, 10.0), ("f", 1, 2, 9.0, float("nan"), 3.0, 10.0), ("g", 1, 0, 1.0, 1.0, 2.0, 2.0)], "file_id string, page int, region_idx int, x double, y double, w double, h double")
    lines = layout.lines_with_human(b, r)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted((x.file_id, x.line_no, x.text, x.n_boxes, x.n_human) for x in lines.collect()) == [("f", 0, "[handwritten] a [handwritten]", 2, 2), ("f", 1, "[handwritten]", 0, 1), ("g", 0, "[handwritten]", 0, 1)]
    assert [x.text for x in layout.scan_text(layout.written(b, r.filter("false"))).collect()] == ["a"]
    assert layout.written(b.filter("false"), r).count() == 2
