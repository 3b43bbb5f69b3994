"""Office documents to Markdown: one text for a whole file.

Packages (docx, xlsx, pptx, odt, ods, odp, epub) are zips of XML; rtf and delimited text are read as
they are. The dialect: `#` headings, `- ` list items, pipe tables, a blank line between blocks; a
sheet or slide starts with a heading. Parts are unpacked within limits, and XML with a document type
of its own is refused, so that no entity can expand.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from itertools import islice
from xml.etree import ElementTree as ET

from ..limits import Limits

#: Formats by the reader they need; binary ones of older suites are routed but have no reader.
WORD, SHEET, SLIDES, OPEN = ("docx", "docm"), ("xlsx", "xlsm"), ("pptx", "pptm", "ppsx", "ppsm"), ("odt", "ods", "odp")


class Unreadable(ValueError):
    """The document can't be converted."""


class Package:
    """A zip's parts, each unpacked when asked for, all together within the limit."""

    def __init__(self, content: bytes, limits: Limits):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:
            raise Unreadable(f"not a readable package: {e}") from None
        self.names = set(self.zip.namelist())
        self.left = limits.archive_bytes

    def part(self, name: str) -> bytes:
        if name not in self.names:
            raise Unreadable(f"the package has no part {name}")
        try:
            with self.zip.open(name) as f:
                out = f.read() if self.left is None else f.read(self.left + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError) as e:
            raise Unreadable(f"part {name} is damaged: {e}") from None
        if self.left is not None:
            self.left -= len(out)
            if self.left < 0:
                raise Unreadable("the package unpacks to more than is allowed")
        return out

    def xml(self, name: str) -> ET.Element:
        return xml(self.part(name), name)


def xml(raw: bytes, name: str = "part") -> ET.Element:
    if b"<!DOCTYPE" in raw and b"<!ENTITY" in raw:
        raise Unreadable(f"{name} declares entities")
    try:
        return ET.fromstring(raw)
    except (ET.ParseError, ValueError, LookupError, RecursionError) as e:
        raise Unreadable(f"{name} is no valid XML: {e}") from None


def tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def get(e: ET.Element, name: str) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _cells(row: list[str]) -> list[str]:
    return [re.sub(r"\s*\n\s*", " ", c).strip().replace("|", "\\|") for c in row]


def _row(cells: list[str], width: int) -> str:
    return "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"


def table(rows: list[list[str]]) -> str:
    """A pipe table; its first row is the head."""
    rows = [_cells(r) for r in rows]
    while rows and not any(rows[-1]):
        rows.pop()
    width = max((len(r) for r in rows), default=0)
    if not width:
        return ""
    lines = [_row(r, width) for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])


def blocks(parts: list[str]) -> str:
    return "\n\n".join(p for p in parts if p.strip())


def heading(level: int, text: str) -> str:
    return f"{'#' * min(6, max(1, level))} {text.strip()}" if text.strip() else ""


# ---------------------------------------------------------------- word processing


def _word_text(p: ET.Element) -> str:
    says = {"t": lambda e: e.text or "", "tab": lambda e: "\t", "br": lambda e: "\n", "cr": lambda e: "\n"}
    return "".join(says[tag(e)](e) for part in p if tag(part) != "pPr" for e in part.iter() if tag(e) in says)


def _word_block(e: ET.Element) -> str:
    if tag(e) == "tbl":
        return table([[" ".join(_word_text(p) for p in c.iter() if tag(p) == "p") for c in r if tag(c) == "tc"] for r in e if tag(r) == "tr"])
    if tag(e) == "sdt":
        return blocks([_word_block(x) for c in e if tag(c) == "sdtContent" for x in c])
    if tag(e) != "p":
        return ""
    text, style, listed = _word_text(e).strip(), "", False
    for props in (x for x in e if tag(x) == "pPr"):
        style = next((get(x, "val") or "" for x in props if tag(x) == "pStyle"), "")
        listed = any(tag(x) == "numPr" for x in props)
    if m := re.fullmatch(r"(?i)heading\s*([1-6])|title", style):
        return heading(int(m[1] or 1), text)
    return f"- {text}" if listed and text else text


def docx(content: bytes, limits: Limits) -> str:
    body = next((e for e in Package(content, limits).xml("word/document.xml") if tag(e) == "body"), None)
    return blocks([_word_block(e) for e in body]) if body is not None else ""


# ---------------------------------------------------------------- sheets


def _relations(package: Package, part: str) -> dict[str, str]:
    """Targets of a part's relations, by id."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"
    if rels not in package.names:
        return {}
    found = {}
    for r in package.xml(rels):
        target = r.get("Target") or ""
        found[r.get("Id") or ""] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return found


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def xlsx(content: bytes, limits: Limits) -> str:
    package = Package(content, limits)
    book, targets = package.xml("xl/workbook.xml"), _relations(package, "xl/workbook.xml")
    shared = []
    if "xl/sharedStrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in s.iter() if tag(t) == "t") for s in package.xml("xl/sharedStrings.xml") if tag(s) == "si"]
    out = []
    for sheet in (e for e in book.iter() if tag(e) == "sheet"):
        part = targets.get(get(sheet, "id") or "")
        if part not in package.names:
            continue
        rows = [_sheet_row(r, shared) for r in package.xml(part).iter() if tag(r) == "row"]
        out += [heading(2, sheet.get("name") or ""), table([r for r in rows if any(r)])]
    return blocks(out)


def _sheet_row(row: ET.Element, shared: list[str]) -> list[str]:
    cells: list[str] = []
    for c in (x for x in row if tag(x) == "c"):
        at = _column(c.get("r") or "")
        at = at if 0 <= at < 16384 else len(cells)
        cells += [""] * (at + 1 - len(cells))
        kind = c.get("t")
        value = "".join(v.text or "" for v in c.iter() if tag(v) == ("t" if kind == "inlineStr" else "v"))
        if kind == "s":
            value = shared[int(value)] if value.isdigit() and int(value) < len(shared) else ""
        elif kind == "b":
            value = "TRUE" if value == "1" else "FALSE"
        cells[at] = value
    return cells


# ---------------------------------------------------------------- slides


def pptx(content: bytes, limits: Limits) -> str:
    package = Package(content, limits)
    targets, out = _relations(package, "ppt/presentation.xml"), []
    slides = [e for e in package.xml("ppt/presentation.xml").iter() if tag(e) == "sldId"]
    parts = [targets.get(v) for e in slides for k, v in e.attrib.items() if k.endswith("}id")]
    for k, part in enumerate(parts, 1):
        if part not in package.names:
            continue
        title, body = "", []
        for shape in (e for e in package.xml(part).iter() if tag(e) in ("sp", "tbl")):
            if tag(shape) == "tbl":
                body.append(table([["".join(t.text or "" for t in c.iter() if tag(t) == "t") for c in r if tag(c) == "tc"] for r in shape if tag(r) == "tr"]))
                continue
            holder = next((get(e, "type") or "body" for e in shape.iter() if tag(e) == "ph"), None)
            lines = ["".join(t.text or "" for t in p.iter() if tag(t) == "t").strip() for p in shape.iter() if tag(p) == "p"]
            lines = [x for x in lines if x]
            if holder in ("title", "ctrTitle") and not title:
                title = " ".join(lines)
            else:
                body += [f"- {x}" for x in lines] if holder == "body" else lines
        out += [heading(2, title or f"Slide {k}"), *body]
    return blocks(out)


# ---------------------------------------------------------------- open documents


def _open_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for c in e:
        kind = tag(c)
        if kind == "s":
            n = get(c, "c") or "1"
            out.append(" " * (min(int(n), 1000) if n.isdigit() else 1))
        elif kind == "tab":
            out.append("\t")
        elif kind == "line-break":
            out.append("\n")
        elif kind not in ("note", "annotation"):
            out.append(_open_text(c))
        out.append(c.tail or "")
    return "".join(out)


def _open_table(e: ET.Element) -> str:
    rows = []
    for r in (x for x in e.iter() if tag(x) == "table-row"):
        cells: list[str] = []
        for c in (x for x in r if tag(x) in ("table-cell", "covered-table-cell")):
            text = " ".join(_open_text(p) for p in c.iter() if tag(p) == "p")
            n = get(c, "number-columns-repeated") or "1"
            n = int(n) if n.isdigit() else 1
            cells += [text] * (min(n, 1024) if text else min(n, 64))
        while cells and not cells[-1]:
            cells.pop()
        if cells:
            rows.append(cells)
    return table(rows)


def _open_blocks(e: ET.Element) -> Iterator[str]:
    for c in e:
        kind = tag(c)
        if kind == "h":
            level = get(c, "outline-level") or "1"
            yield heading(int(level) if level.isdigit() else 1, _open_text(c))
        elif kind == "p":
            yield _open_text(c).strip()
            yield from (x for frame in c if tag(frame) == "frame" for x in _open_blocks(frame))
        elif kind == "list":
            yield from (f"- {x}" if x and not x.startswith("- ") else x for item in c if tag(item) == "list-item" for x in _open_blocks(item))
        elif kind == "table":
            if name := get(c, "name") if tag(e) == "spreadsheet" else None:
                yield heading(2, name)
            yield _open_table(c)
        elif kind == "page":
            yield heading(2, get(c, "name") or "")
            yield from _open_blocks(c)
        elif kind not in ("tracked-changes", "notes"):
            yield from _open_blocks(c)


def opendocument(content: bytes, limits: Limits) -> str:
    root = Package(content, limits).xml("content.xml")
    return blocks([x for body in root if tag(body) == "body" for x in _open_blocks(body)])


# ---------------------------------------------------------------- books


_LEVELS = {f"h{k}": k for k in range(1, 7)}


def _book_blocks(e: ET.Element) -> Iterator[str]:
    for c in e:
        kind, text = tag(c), lambda c=c: re.sub(r"\s+", " ", "".join(c.itertext())).strip()
        if kind in _LEVELS:
            yield heading(_LEVELS[kind], text())
        elif kind in ("p", "blockquote", "pre"):
            yield text()
        elif kind == "li":
            yield f"- {text()}"
        elif kind == "table":
            yield table([[re.sub(r"\s+", " ", "".join(x.itertext())) for x in r if tag(x) in ("td", "th")] for r in c.iter() if tag(r) == "tr"])
        elif kind not in ("script", "style", "head"):
            yield from _book_blocks(c)


def epub(content: bytes, limits: Limits) -> str:
    package = Package(content, limits)
    root = next((get(e, "full-path") for e in package.xml("META-INF/container.xml").iter() if tag(e) == "rootfile"), None)
    if not root:
        raise Unreadable("the book has no package document")
    opf, folder = package.xml(root), posixpath.dirname(root)
    items = {e.get("id"): e.get("href") or "" for e in opf.iter() if tag(e) == "item"}
    out = []
    for ref in (e for e in opf.iter() if tag(e) == "itemref"):
        part = posixpath.normpath(posixpath.join(folder, items.get(ref.get("idref"), "")))
        if part in package.names:
            out += _book_blocks(package.xml(part))
    return blocks(out)


# ---------------------------------------------------------------- rich and delimited text

_RTF = re.compile(r"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\(.)|([{}])|([^\\{}]+)", re.S)
#: Groups whose text isn't the document's.
_RTF_ASIDE = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "headerl", "headerr", "footerl", "footerr", "object", "themedata", "datastore", "listtable", "listoverridetable", "rsidtbl", "generator", "xmlnstbl", "latentstyles", "footnote"}
_RTF_SAYS = {"par": "\n\n", "sect": "\n\n", "page": "\n\n", "line": "\n", "tab": "\t", "cell": "\t", "row": "\n", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•"}


def rtf(content: bytes, limits: Limits) -> str:
    text = content.decode("latin-1")
    if not text.lstrip().startswith("{\\rtf"):
        raise Unreadable("not rich text")
    page = re.search(r"\\ansicpg(\d+)", text[:4096])
    codec = f"cp{page[1]}" if page else "cp1252"
    try:
        b"".decode(codec)
    except LookupError:
        codec = "cp1252"
    out, stack, aside, skip, unicode_skip, pending = [], [], False, 0, 1, bytearray()

    def flush():
        if pending:
            out.append(pending.decode(codec, "replace"))
            pending.clear()

    for m in _RTF.finditer(text):
        word, number, code, symbol, brace, plain = m.groups()
        if code and not aside:
            if skip:
                skip -= 1
            else:
                pending.append(int(code, 16))
            continue
        flush()
        if brace == "{":
            stack.append((aside, unicode_skip))
        elif brace == "}":
            aside, unicode_skip = stack.pop() if stack else (False, 1)
            skip = 0
        elif word:
            if word in _RTF_ASIDE:
                aside = True
            elif word == "uc":
                unicode_skip = int(number or 1)
            elif word == "u" and number and not aside:
                out.append(chr(int(number) % 65536))
                skip = unicode_skip
            elif word in _RTF_SAYS and not aside:
                out.append(_RTF_SAYS[word])
        elif symbol:
            if symbol == "*":
                aside = True
            elif symbol in "\\{}" and not aside:
                out.append(symbol)
            elif symbol == "~" and not aside:
                out.append(" ")
        elif plain and not aside:
            plain = plain.replace("\r", "").replace("\n", "")
            if skip:
                plain, skip = plain[skip:], max(0, skip - len(plain))
            out.append(plain)
    flush()
    joined = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return blocks([x.strip() for x in re.split(r"\n\s*\n", joined)])


def delimited(content: bytes, limits: Limits, delimiter: str | None = None) -> str:
    """The table() of its rows, in two passes: rows aren't kept."""
    text = content.decode("utf-8-sig", "replace")
    if delimiter is None:
        head = list(islice((m[0] for m in re.finditer(r"[^\n]+", text) if m[0].strip()), 12))
        delimiter = max(",;\t|", key=lambda d: sum(re.sub(r'"[^"]*("|$)', "", x).count(d) for x in head))
    rows = lambda: (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r)
    last = width = widest = 0
    try:
        for n, r in enumerate(rows(), 1):
            widest = max(widest, len(r))
            if any(c.strip() for c in r):
                last, width = n, widest
        if not width:
            return ""
        return "\n".join(f"{_row(_cells(r), width)}\n|{' --- |' * width}" if n == 0 else _row(_cells(r), width) for n, r in enumerate(islice(rows(), last)))
    except csv.Error as e:
        raise Unreadable(f"not delimited text: {e}") from None


READERS: dict[str, Callable[[bytes, Limits], str]] = {**dict.fromkeys(WORD, docx), **dict.fromkeys(SHEET, xlsx), **dict.fromkeys(SLIDES, pptx), **dict.fromkeys(OPEN, opendocument), "epub": epub, "rtf": rtf, "csv": delimited}


def to_markdown(content: bytes, fmt: str, limits: Limits | None = None) -> str:
    """Markdown of a document of a known format; raises Unreadable."""
    if fmt not in READERS:
        raise Unreadable(f"there is no reader for {fmt} files")
    try:
        return READERS[fmt](content, limits or Limits())
    except RecursionError:
        raise Unreadable("the document is nested too deeply") from None
