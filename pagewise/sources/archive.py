"""The archive guard: counts what an archive really unpacks to, and keeps only what is an archive again."""

from __future__ import annotations

import bz2
import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..limits import Limits

STEP = 16 * 1024


def looks_like_zip(content: bytes) -> bool:
    return len(content) >= 4 and content[:2] == b"PK"


def _produced(content: bytes, entry: zipfile.ZipInfo) -> Iterator[bytes]:
    """Pieces of an entry, inflated from its raw stream: its headers aren't believed."""
    at = entry.header_offset
    start = at + 30 + int.from_bytes(content[at + 26 : at + 28], "little") + int.from_bytes(content[at + 28 : at + 30], "little")
    raw = memoryview(content)[start : start + entry.compress_size]
    if entry.compress_type == zipfile.ZIP_STORED:
        yield bytes(raw)
        return
    # other methods must obey the same ceiling: their unpackers are asked for pieces as well
    inflate = {zipfile.ZIP_BZIP2: bz2.BZ2Decompressor, zipfile.ZIP_LZMA: lambda: None}.get(entry.compress_type, lambda: zlib.decompressobj(-15))()
    if inflate is None:
        raise zlib.error("a method that no reader here unpacks")
    if isinstance(inflate, bz2.BZ2Decompressor):
        for k in range(0, len(raw), STEP):
            piece = bytes(raw[k : k + STEP])
            while not inflate.eof:
                yield inflate.decompress(piece, STEP)
                piece = b""
                if inflate.needs_input:
                    break
        return
    for k in range(0, len(raw), STEP):
        left = bytes(raw[k : k + STEP])
        while left:
            yield inflate.decompress(left, STEP)
            left = inflate.unconsumed_tail


def check(content: bytes, limits: Limits, depth: int = 0) -> tuple[str, int, int | None] | None:
    """(limit, allowed, found) of the first ceiling that is passed, or None. What is no readable zip passes."""
    if not looks_like_zip(content):
        return None
    try:
        entries = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except (zipfile.BadZipFile, ValueError, NotImplementedError):
        return None
    if limits.archive_depth is not None and depth > limits.archive_depth:
        return "archive nesting depth", limits.archive_depth, depth
    if limits.archive_entries is not None and len(entries) > limits.archive_entries:
        return "archive entries", limits.archive_entries, len(entries)
    cap = limits.archive_bytes
    declared = sum(e.file_size for e in entries)
    if cap is not None and declared > cap:
        return "declared decompressed bytes", cap, declared
    total = 0
    for entry in entries:
        if entry.is_dir():
            continue
        inner, nested = [], None
        try:
            for piece in _produced(content, entry):
                total += len(piece)
                if cap is not None and total > cap:
                    return "decompressed bytes", cap, None
                nested = piece[:2] == b"PK" if nested is None and piece else nested
                if nested:
                    inner.append(piece)
        except (zlib.error, OSError, EOFError):
            continue
        if nested and (found := check(b"".join(inner), limits, depth + 1)):
            return found
    return None


def check_files(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """files (path, content) to (path, exceeded). Content leaves the JVM a few files at a time."""
    limits = limits or Limits()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [check(bytes(c), limits) if c is not None else None for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "exceeded": [f and {"limit": f[0], "allowed": f[1], "found": f[2]} for f in found]})

    return files.select("path", "content").mapInPandas(run, "path string, exceeded struct<limit:string,allowed:bigint,found:bigint>")
