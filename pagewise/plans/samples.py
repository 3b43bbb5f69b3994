"""Small files of every format that is read, made from text: what queries and tests read back."""

from __future__ import annotations

import hashlib
import io
import zipfile
import zlib
from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape

from ..sources.pdf import PADDING, rc4

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
O = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'  # noqa: E741


def package(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _relations(targets: Sequence[str]) -> str:
    rows = "".join(f'<Relationship Id="rId{k}" Target="{t}"/>' for k, t in enumerate(targets, 1))
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def docx(lines: Iterable[str], title: str | None = None) -> bytes:
    head = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p>' if title else ""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    return package({"word/document.xml": f"<w:document {W}><w:body>{head}{body}</w:body></w:document>"})


def xlsx(sheets: Sequence[tuple[str, Iterable[Sequence[str]]]]) -> bytes:
    """Every second cell is a shared string, the others are inline."""
    shared: list[str] = []
    parts: dict[str, str | bytes] = {}
    for k, (_, rows) in enumerate(sheets, 1):
        body = []
        for y, row in enumerate(rows, 1):
            cells = []
            for x, value in enumerate(row):
                at = f"{chr(65 + x)}{y}"
                if x % 2:
                    shared.append(value)
                    cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
                else:
                    cells.append(f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>')
            body.append(f'<row r="{y}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet {S}><sheetData>{''.join(body)}</sheetData></worksheet>"
    names = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, (n, _) in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f"<workbook {S}><sheets>{names}</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = _relations([f"worksheets/sheet{k}.xml" for k in range(1, len(sheets) + 1)])
    parts["xl/sharedStrings.xml"] = f"<sst {S}>{''.join(f'<si><t>{escape(x)}</t></si>' for x in shared)}</sst>"
    return package(parts)


def pptx(slides: Sequence[tuple[str, Sequence[str]]]) -> bytes:
    parts: dict[str, str | bytes] = {}
    for k, (title, lines) in enumerate(slides, 1):
        say = lambda text: f"<a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p>"
        head = f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody>{say(title)}</p:txBody></p:sp>'
        body = f'<p:sp><p:nvSpPr><p:nvPr/></p:nvSpPr><p:txBody>{"".join(map(say, lines))}</p:txBody></p:sp>'
        parts[f"ppt/slides/slide{k}.xml"] = f"<p:sld {P}><p:cSld><p:spTree>{head}{body}</p:spTree></p:cSld></p:sld>"
    ids = "".join(f'<p:sldId id="{255 + k}" r:id="rId{k}"/>' for k in range(1, len(slides) + 1))
    parts["ppt/presentation.xml"] = f"<p:presentation {P}><p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    parts["ppt/_rels/presentation.xml.rels"] = _relations([f"slides/slide{k}.xml" for k in range(1, len(slides) + 1)])
    return package(parts)


def opendocument(kind: str, body: str) -> bytes:
    """kind: text, spreadsheet or presentation; body: what its element holds."""
    inner = f"<office:document-content {O}><office:body><office:{kind}>{body}</office:{kind}></office:body></office:document-content>"
    return package({"mimetype": f"application/vnd.oasis.opendocument.{kind}", "content.xml": inner})


def odt(title: str, lines: Iterable[str]) -> bytes:
    said = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    return opendocument("text", f'<text:h text:outline-level="2">{escape(title)}</text:h>{said}')


def ods(name: str, rows: Iterable[Sequence[str]]) -> bytes:
    said = "".join("<table:table-row>" + "".join(f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>" for c in r) + "</table:table-row>" for r in rows)
    return opendocument("spreadsheet", f'<table:table table:name="{escape(name)}">{said}</table:table>')


def odp(slides: Sequence[tuple[str, Sequence[str]]]) -> bytes:
    pages = "".join(f'<draw:page draw:name="{escape(n)}"><draw:frame><draw:text-box>{"".join(f"<text:p>{escape(x)}</text:p>" for x in lines)}</draw:text-box></draw:frame></draw:page>' for n, lines in slides)
    return opendocument("presentation", pages)


def epub(chapters: Sequence[tuple[str, Sequence[str]]]) -> bytes:
    parts: dict[str, str | bytes] = {"mimetype": "application/epub+zip", "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>'}
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k in range(len(chapters)))
    spine = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    parts["OEBPS/book.opf"] = f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>'
    for k, (title, lines) in enumerate(chapters):
        said = "".join(f"<p>{escape(x)}</p>" for x in lines)
        parts[f"OEBPS/c{k}.xhtml"] = f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>no</title></head><body><h2>{escape(title)}</h2><div>{said}</div></body></html>'
    return package(parts)


def rtf(lines: Iterable[str]) -> bytes:
    def say(text: str) -> str:
        out = []
        for c in text:
            units = c.encode("utf-16-le")
            out.append(f"\\{c}" if c in "\\{}" else c if " " <= c <= "~" else "".join(f"\\u{int.from_bytes(units[k : k + 2], 'little', signed=True)}?" for k in range(0, len(units), 2)))
        return "".join(out)

    return ("{\\rtf1\\ansi{\\fonttbl{\\f0 Helvetica;}}{\\*\\generator none;}\\f0\n" + "\n".join(f"{say(x)}\\par" for x in lines) + "}").encode("ascii")


def _literal(text: str) -> bytes:
    return b"(" + text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"


def pdf(pages: Sequence[Sequence[str] | None], *, password: str | None = None) -> bytes:
    """A page is lines of text, or None for a picture without any. password: encrypt (RC4, 40 bits) with
    this user password, which may be empty."""
    bodies: list[bytes] = [b"<</Type/Catalog/Pages 2 0 R>>", b"", b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    streams: dict[int, tuple[bytes, bytes]] = {}

    def stream(info: bytes, raw: bytes) -> int:
        bodies.append(b"")
        streams[len(bodies)] = info, raw
        return len(bodies)

    picture = stream(b"/Type/XObject/Subtype/Image/Width 1/Height 1/ColorSpace/DeviceGray/BitsPerComponent 8", b"\x7f")
    kids = []
    for lines in pages:
        if lines is None:
            said = b"q 595 0 0 842 0 0 cm /Im0 Do Q"
        else:
            said = b"BT /F0 12 Tf 14 TL 50 790 Td " + b" ".join(_literal(x) + b" Tj T*" for x in lines) + b" ET"
        content = stream(b"/Filter/FlateDecode", zlib.compress(said))
        bodies.append(b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F0 3 0 R>>/XObject<</Im0 %d 0 R>>>>/Contents %d 0 R>>" % (picture, content))
        kids.append(len(bodies))
    bodies[1] = b"<</Type/Pages/Kids[%s]/Count %d>>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    file_id, key, trailer = b"0123456789abcdef", None, b""
    if password is not None:
        owner, rights = rc4(hashlib.md5(PADDING).digest()[:5], (password.encode() + PADDING)[:32]), -4
        key = hashlib.md5((password.encode() + PADDING)[:32] + owner + (rights & 0xFFFFFFFF).to_bytes(4, "little") + file_id).digest()[:5]
        bodies.append(b"<</Filter/Standard/V 1/R 2/O<%s>/U<%s>/P %d>>" % (owner.hex().encode(), rc4(key, PADDING).hex().encode(), rights))
        trailer = b"/Encrypt %d 0 R/ID[<%s><%s>]" % (len(bodies), file_id.hex().encode(), file_id.hex().encode())
    out, places = bytearray(b"%PDF-1.4\n"), []
    for n, body in enumerate(bodies, 1):
        if n in streams:
            info, raw = streams[n]
            raw = rc4(hashlib.md5(key + n.to_bytes(3, "little") + b"\0\0").digest()[:10], raw) if key else raw
            body = b"<<%s/Length %d>>\nstream\n%s\nendstream" % (info, len(raw), raw)
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % at for at in places)
    out += b"trailer\n<</Size %d/Root 1 0 R%s>>\nstartxref\n%d\n%%%%EOF" % (len(bodies) + 1, trailer, start)
    return bytes(out)
