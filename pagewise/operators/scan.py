"""Page images as tables: straightened pixels, and the boxes and handwriting that an engine reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import Limits
from ..ocr import engine as ocr
from ..sources import raster

_PREPARED = {
    "width": pa.int32(), "height": pa.int32(), "rotation": pa.int32(), "skew": pa.float64(), "crop_x": pa.int32(), "crop_y": pa.int32(),
    "original_width": pa.int32(), "original_height": pa.int32(), "pixels": pa.binary(), "error": pa.string(),
}


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {dict(df.dtypes)[c]}" for c in columns)


def _mapped(files: DataFrame, key: str, names: dict, ddl: str, one) -> DataFrame:
    """files (key, content) to a row each: the key and what `one` makes of the content, as a dict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # an image at a time leaves and is let go
                got = one(batch.column(1)[k].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *[pa.array([got.get(n)], t) for n, t in names.items()]], names=[key, *names])

    return files.select(key, "content").mapInArrow(run, f"{_ddl(files, key)}, {ddl}")


def prepare_images(files: DataFrame, *, profile: str = "photograph", options: ocr.ScanOptions | None = None, limits: Limits | None = None, decoder: raster.DecodeImage | None = None, key: str = "path") -> DataFrame:
    """files (key, content) to straightened pixels and the way back: one row a file, always."""
    options = options or ocr.profile(profile)

    def one(content) -> dict:
        try:
            p = ocr.prepare(bytes(content or b""), options, limits, decoder)
        except (raster.TooLarge, raster.Undecodable) as e:
            return {"error": str(e)}
        c = p.correction
        return {
            "width": p.image.shape[1], "height": p.image.shape[0], "rotation": c.rotation, "skew": c.skew, "crop_x": c.crop_origin[0], "crop_y": c.crop_origin[1],
            "original_width": c.original[0], "original_height": c.original[1], "pixels": p.image.tobytes(),
        }

    ddl = "width int, height int, rotation int, skew double, crop_x int, crop_y int, original_width int, original_height int, pixels binary, error string"
    return _mapped(files, key, _PREPARED, ddl, one)


_RECT = [("x", pa.float64()), ("y", pa.float64()), ("w", pa.float64()), ("h", pa.float64())]
_INK = ("stroke_width", "stroke_variation", "baseline_drift", "coverage")
_SCANNED = {
    "width": pa.int32(), "height": pa.int32(), "rotation": pa.int32(), "skew": pa.float64(), "elapsed_ms": pa.int64(),
    "boxes": pa.list_(pa.struct([("text", pa.string()), *_RECT, ("confidence", pa.float64())])),
    "regions": pa.list_(pa.struct([*_RECT, *[(n, pa.float64()) for n in _INK], ("confidence", pa.float64()), ("page_confidence", pa.float64())])),
    "error": pa.string(),
}
_SCANNED_DDL = (
    "width int, height int, rotation int, skew double, elapsed_ms bigint, boxes array<struct<text:string,x:double,y:double,w:double,h:double,confidence:double>>, "
    "regions array<struct<x:double,y:double,w:double,h:double,stroke_width:double,stroke_variation:double,baseline_drift:double,coverage:double,confidence:double,page_confidence:double>>, error string"
)


def _rect(quad: ocr.Quad) -> dict:
    return dict(zip("xywh", map(float, ocr.bounds(quad)), strict=True))


def scan_images(files: DataFrame, backend: ocr.Backend, *, key: str = "file_id") -> DataFrame:
    """files (key, content) to what the backend reads of each: arrays of boxes and handwritten regions, or an error."""

    def one(content) -> dict:
        try:
            s = backend.read_image(bytes(content or b""))
        except (raster.TooLarge, raster.Undecodable, ArithmeticError, LookupError, RuntimeError, ValueError) as e:
            return {"error": str(e) or type(e).__name__}
        boxes = [{"text": b.text, **_rect(b.quad), "confidence": float(b.confidence)} for b in s.boxes]
        regions = [{**_rect(r.quad), **{n: float(getattr(r.ink, n)) for n in _INK}, "confidence": float(r.confidence), "page_confidence": float(r.page_confidence)} for r in s.human]
        return {"width": s.width, "height": s.height, "rotation": s.rotation, "skew": float(s.skew), "elapsed_ms": s.elapsed_ms, "boxes": boxes, "regions": regions}

    return _mapped(files, key, _SCANNED, _SCANNED_DDL, one)


def boxes_of(scans: DataFrame, key: str = "file_id") -> DataFrame:
    """The boxes table that layout works on; each image is page 1 of its file."""
    at = scans.select(F.col(key).alias("file_id"), F.lit(1).alias("page"), F.col("width").cast("double").alias("page_width"), F.posexplode("boxes").alias("box_idx", "b"))
    return at.select("file_id", "page", "box_idx", "b.*", "page_width")


def regions_of(scans: DataFrame, key: str = "file_id") -> DataFrame:
    at = scans.select(F.col(key).alias("file_id"), F.lit(1).alias("page"), F.posexplode("regions").alias("region_idx", "r"))
    return at.select("file_id", "page", "region_idx", "r.*")


def read_image_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, width, height, pixels) of image files that the JVM decodes: JPEG, PNG, BMP, TIFF and GIF. Grey,
    8 bits; a file that can't be decoded has null pixels."""
    read = spark.read.format("image").option("dropInvalid", False).options(**options).load(path).select("image.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grey, n = None, r["nChannels"]
                if n and n > 0 and r["data"]:
                    px = raster.np.frombuffer(r["data"], raster.np.uint8).reshape(r["height"], r["width"], n)
                    grey = (px[:, :, 0] if n == 1 else raster.grey(px[:, :, 2::-1])).tobytes()
                sizes = [r["width"] if grey else None, r["height"] if grey else None]
                yield pa.RecordBatch.from_arrays([pa.array([r["origin"]]), pa.array(sizes[:1], pa.int32()), pa.array(sizes[1:], pa.int32()), pa.array([grey], pa.binary())], names=["path", "width", "height", "pixels"])

    return read.select("origin", "height", "width", "nChannels", "data").mapInArrow(run, "path string, width int, height int, pixels binary")
