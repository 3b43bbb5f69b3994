"""Ingestion as a stream: files are routed as they arrive, by the same projection as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import read, route

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).option("maxFilesPerTrigger", max_files).load(path)


def stream_plans(spark: SparkSession, path: str, **options) -> DataFrame:
    """Append-only plans of arriving files; stateless, so it needs no watermark."""
    return route.inspect(stream_files(spark, path, **options), filename="path")


def stream_documents(spark: SparkSession, path: str, *, max_files: int = 1000, **options) -> DataFrame:
    """Append-only documents of arriving files, read by the same gates and readers as in a batch."""
    files = stream_files(spark, path, max_files=max_files)
    return read.read_documents(files.select(files.path.alias("file_id"), "content", files.path.alias("filename")), **options)
