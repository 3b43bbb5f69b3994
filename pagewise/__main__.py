"""Command line: python -m pagewise [options] PATH

Reads the files at PATH (a file, a folder or a pattern) and writes their Markdown.

  -o, --out DIR   write documents as JSON lines to a folder instead of standard output
  --inspect       say what each file is and what reading it would cost, and read nothing
  --json          JSON, a line a file
  --pages         mark where pages begin
  --strict        fail files with pages that need OCR
  -h, --help      this text

Exit codes: 0 all was read, 1 something failed, 2 wrong usage, 3 pages are left unresolved.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import read, route

FLAGS = ("--inspect", "--json", "--pages", "--strict")


def parse(args: list[str]) -> dict | None:
    """Options and path, or None for wrong usage; the last path counts."""
    out = {"path": None, "out": None} | {f[2:]: False for f in FLAGS}
    rest = list(args)
    while rest:
        a = rest.pop(0)
        if a in ("-o", "--out"):
            if not rest:
                return None
            out["out"] = rest.pop(0)
        elif a in FLAGS:
            out[a[2:]] = True
        elif a.startswith("-"):
            return None
        else:
            out["path"] = a
    return out if out["path"] else None


def _said(df: DataFrame, as_json: bool, text) -> None:
    """A row at a time, so that the driver holds one document and no more."""
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False) if as_json else text(row))


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if "-h" in args or "--help" in args:
        print(__doc__)
        return 0
    o = parse(args)
    if not o:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("pagewise").getOrCreate()
    try:
        if o["inspect"]:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(o["path"]).select("path", "content")
            plans = route.inspect(files, "path", survey=True)
            _said(plans.select("path", "route", "format", "kind", "page_count", "needs_ocr", "ocr_page_count", "summary"), o["json"], lambda r: f"{r.path}: {r.summary}")
            return 0
        docs = read.read_path(spark, o["path"], page_markers=o["pages"], strict=o["strict"])
        about = ("file_id", "route", "format", "page_count", "ocr_pages", "unresolved_pages", "human_pages", "complete", "receipt", "elapsed_ms", "markdown", "error")
        if o["out"]:
            docs.select(*about).write.json(o["out"])
            docs = spark.read.schema(docs.select(*about).schema).json(o["out"])
        else:
            docs = docs.select(*about).persist()
            _said(docs, o["json"], lambda r: r.markdown if r.error is None else f"{r.file_id}: {r.error.message}")
        failed, partial = docs.agg(F.count_if(F.col("error").isNotNull()), F.count_if(~F.coalesce("complete", F.lit(True)))).first()
        return 1 if failed else 3 if partial else 0
    except Exception as e:  # noqa: BLE001 - the command says what went wrong instead of a trace
        print(f"pagewise: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
