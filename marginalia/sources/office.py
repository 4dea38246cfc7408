"""Markdown of office documents by their file formats alone: DOCX, PPTX, ODT, ODP, EPUB and RTF; sheets of ODS.

All but RTF are zip files of XML.  An archive whose parts would unpack to more than UNPACKED bytes is refused."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

UNPACKED = 256 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
_DRAW = "{urn:oasis:names:tc:opendocument:xmlns:drawing:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"
_DC = "{http://purl.org/dc/elements/1.1/}"


class OfficeError(ValueError):
    """A file that isn't what its name says, or is too large."""


class _Archive:
    def __init__(self, data: bytes) -> None:
        try:
            self.z = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile:
            raise OfficeError("not an archive") from None
        if sum(i.file_size for i in self.z.infolist()) > UNPACKED:
            raise OfficeError("too large when unpacked")
        self.names = set(self.z.namelist())

    def xml(self, name: str) -> ElementTree.Element | None:
        if name not in self.names:
            return None
        try:
            return ElementTree.fromstring(self.z.read(name))
        except (ElementTree.ParseError, RuntimeError, zipfile.BadZipFile, NotImplementedError) as e:
            raise OfficeError(f"{name}: {str(e).split(chr(10))[0]}") from None

    def need(self, name: str) -> ElementTree.Element:
        root = self.xml(name)
        if root is None:
            raise OfficeError(f"no {name}")
        return root

    def title(self) -> str | None:
        for name in ("docProps/core.xml", "meta.xml"):
            root = self.xml(name)
            for t in root.iter(f"{_DC}title") if root is not None else ():
                if t.text and t.text.strip():
                    return " ".join(t.text.split())
        return None


def _pipes(rows: list[list[str]]) -> str:
    rows = [r for r in rows if any(c.strip() for c in r)]
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join([" ".join(c.split()).replace("|", "\\|") for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])]) if width else ""


def _joined(blocks: Iterator[tuple[str, str]]) -> str:
    """Blocks of (kind, text) with a blank line between them, but none between the items of a list."""
    out, last = [], ""
    for kind, text in blocks:
        if text.strip():
            out.append(("" if not out else "\n" if kind == last == "item" else "\n\n") + text.rstrip())
            last = kind
    return "".join(out) + "\n"


# -- word processing ---------------------------------------------------------------------------------


def _docx_text(p: ElementTree.Element) -> str:
    out = []
    for e in p.iter():
        if e.tag == f"{_W}t":
            out.append(e.text or "")
        elif e.tag == f"{_W}tab":
            out.append("\t")
        elif e.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def docx(data: bytes) -> tuple[str, str | None]:
    z = _Archive(data)
    body = z.need("word/document.xml").find(f"{_W}body")
    styles = z.xml("word/styles.xml")
    levels = {}  # style -> heading level, by outline level or name
    for s in styles.iter(f"{_W}style") if styles is not None else ():
        name = s.find(f"{_W}name")
        outline = s.find(f"{_W}pPr/{_W}outlineLvl")
        if outline is not None:
            levels[s.get(f"{_W}styleId")] = int(outline.get(f"{_W}val", "0")) + 1
        elif name is not None and (m := re.fullmatch(r"(?i)heading ([1-9])", name.get(f"{_W}val", ""))):
            levels[s.get(f"{_W}styleId")] = int(m[1])

    def blocks() -> Iterator[tuple[str, str]]:
        for e in body if body is not None else ():
            if e.tag == f"{_W}tbl":
                yield "table", _pipes([[" ".join(_docx_text(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in e.iter(f"{_W}tr")])
            elif e.tag == f"{_W}p":
                text, style = _docx_text(e).strip(), e.find(f"{_W}pPr/{_W}pStyle")
                name = style.get(f"{_W}val", "") if style is not None else ""
                level = levels.get(name) or (1 if name == "Title" else int(m[1]) if (m := re.fullmatch(r"Heading([1-9])", name)) else 0)
                item = e.find(f"{_W}pPr/{_W}numPr")
                if level and text:
                    yield "heading", "#" * min(level, 6) + " " + " ".join(text.split())
                elif item is not None and text:
                    depth = item.find(f"{_W}ilvl")
                    yield "item", "  " * int(depth.get(f"{_W}val", "0") if depth is not None else 0) + "- " + text.replace("\n", "\n  ")
                else:
                    yield "text", text

    return _joined(blocks()), z.title()


def _odf_text(e: ElementTree.Element) -> str:
    out = [e.text or ""]
    for k in e:
        if k.tag == f"{_TEXT}s":
            out.append(" " * int(k.get(f"{_TEXT}c", "1")))
        elif k.tag == f"{_TEXT}tab":
            out.append("\t")
        elif k.tag == f"{_TEXT}line-break":
            out.append("\n")
        elif k.tag not in (f"{_TEXT}note", f"{_OFFICE}annotation"):
            out.append(_odf_text(k))
        out.append(k.tail or "")
    return "".join(out)


def _odf_blocks(e: ElementTree.Element, depth: int = 0) -> Iterator[tuple[str, str]]:
    for k in e:
        if k.tag == f"{_TEXT}h":
            yield "heading", "#" * min(6, int(k.get(f"{_TEXT}outline-level", "1"))) + " " + " ".join(_odf_text(k).split())
        elif k.tag == f"{_TEXT}p":
            yield "text", _odf_text(k).strip()
        elif k.tag == f"{_TEXT}list":
            for item in k.findall(f"{_TEXT}list-item"):
                for kind, text in _odf_blocks(item, depth + 1):
                    yield "item", text if kind == "item" else "  " * depth + "- " + text
        elif k.tag == f"{_TABLE}table":
            yield "table", _pipes([[" ".join(_odf_text(p) for p in c.iter(f"{_TEXT}p")) for c in r if c.tag == f"{_TABLE}table-cell"] for r in k.iter(f"{_TABLE}table-row")])
        elif k.tag != f"{_TEXT}tracked-changes" and len(k):
            yield from _odf_blocks(k, depth)


def odt(data: bytes) -> tuple[str, str | None]:
    z = _Archive(data)
    body = z.need("content.xml").find(f"{_OFFICE}body")
    return _joined(_odf_blocks(body) if body is not None else iter(())), z.title()


# -- slides ------------------------------------------------------------------------------------------


def pptx(data: bytes) -> tuple[str, str | None]:
    z = _Archive(data)
    slides = sorted((n for n in z.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
    if not slides:
        raise OfficeError("no slides")

    def blocks() -> Iterator[tuple[str, str]]:
        for n, name in enumerate(slides, 1):
            shapes, heading = [], None
            for shape in z.need(name).iter():
                if shape.tag == f"{_P}sp":
                    kind = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    paragraphs = [x for p in shape.iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())]
                    if heading is None and kind is not None and kind.get("type") in ("title", "ctrTitle"):
                        heading = " ".join(paragraphs)
                    else:
                        shapes += [("item", "- " + x) for x in paragraphs] if len(paragraphs) > 1 else [("text", x) for x in paragraphs]
                elif shape.tag == f"{_A}tbl":
                    shapes.append(("table", _pipes([["".join(t.text or "" for t in c.iter(f"{_A}t")) for c in r.findall(f"{_A}tc")] for r in shape.iter(f"{_A}tr")])))
            yield "heading", f"## {heading or f'Slide {n}'}"
            yield from shapes

    return _joined(blocks()), z.title()


def odp(data: bytes) -> tuple[str, str | None]:
    z = _Archive(data)

    def blocks() -> Iterator[tuple[str, str]]:
        for n, page in enumerate(z.need("content.xml").iter(f"{_DRAW}page"), 1):
            yield "heading", f"## {page.get(f'{_DRAW}name') or f'Slide {n}'}"
            yield from _odf_blocks(page)

    return _joined(blocks()), z.title()


# -- books and rich text -----------------------------------------------------------------------------


def epub(data: bytes, html: Callable[[str], tuple[str, str | None]]) -> tuple[str, str | None]:
    """The chapters in reading order; `html` turns a page into markdown."""
    z = _Archive(data)
    local = lambda e: e.tag.rpartition("}")[2]
    at = next((e.get("full-path") for e in z.need("META-INF/container.xml").iter() if local(e) == "rootfile"), None)
    book = z.need(at or "")
    files = {e.get("id"): e.get("href") for e in book.iter() if local(e) == "item"}
    title = next((" ".join(e.text.split()) for e in book.iter(f"{_DC}title") if e.text), None)
    out = []
    for e in book.iter():
        if local(e) == "itemref" and (href := files.get(e.get("idref"))):
            name = posixpath.normpath(posixpath.join(posixpath.dirname(at), href))
            if name in z.names:
                out.append(html(z.z.read(name).decode("utf-8", "replace"))[0].strip())
    return "\n\n".join(x for x in out if x) + "\n", title


_RTF = re.compile(rb"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?|\\([a-zA-Z]+)(-?\d+)? ?|\\([^a-zA-Z])|([{}])|([^\\{}\r\n]+)|[\r\n]+")
#: Groups without text, and words that stand for characters (fixed values of the format).
_RTF_SKIPPED = frozenset(b"fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr themedata colorschememapping latentstyles listtable listoverridetable generator xmlnstbl rsidtbl object fldinst".split())
_RTF_WORDS = {b"par": "\n\n", b"line": "\n", b"tab": "\t", b"cell": " | ", b"row": "\n", b"sect": "\n\n", b"page": "\n\n", b"emdash": "—", b"endash": "–", b"lquote": "‘", b"rquote": "’", b"ldblquote": "“", b"rdblquote": "”", b"bullet": "•"}


def rtf(data: bytes) -> tuple[str, str | None]:
    if not data.startswith(b"{\\rtf"):
        raise OfficeError("not rich text")
    page = re.search(rb"\\ansicpg(\d+)", data[:500])
    codec = f"cp{int(page[1])}" if page else "cp1252"
    out: list[str] = []
    stack, skip, after, left, first = [], False, 1, 0, False
    for m in _RTF.finditer(data):
        code, uni, word, value, symbol, brace, text = m.groups()
        if brace == b"{":
            stack.append((skip, after))
            first = True
            continue
        if brace == b"}":
            skip, after = stack.pop() if stack else (False, 1)
        elif symbol == b"*" and first:
            skip = True
        elif word:
            if first and word in _RTF_SKIPPED:
                skip = True
            elif word == b"uc":
                after = int(value or 1)
            elif not skip:
                out.append(_RTF_WORDS.get(word, ""))
        elif uni is not None:
            if not skip:
                out.append(chr(int(uni) % 65536))
                left = after
            continue
        elif code or text or symbol:
            if code:
                try:
                    x = bytes([int(code, 16)]).decode(codec, "replace")
                except LookupError:
                    x = bytes([int(code, 16)]).decode("latin-1")
            else:
                x = text.decode("latin-1") if text else {b"~": "\u00a0", b"_": "-", b"-": ""}.get(symbol, symbol.decode("latin-1"))
            n = min(left, len(x))
            left -= n
            if not skip:
                out.append(x[n:])
        first = False
    whole = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", whole)).strip() + "\n", None


# -- sheets ------------------------------------------------------------------------------------------


def ods_sheets(data: bytes) -> list[tuple[str, list[list[str | None]]]]:
    """(sheet, rows of texts) of every sheet with content; repeated cells and rows without content are left out at the
    ends."""
    out = []
    for t in _Archive(data).need("content.xml").iter(f"{_TABLE}table"):
        rows: list[list[str | None]] = []
        for r in t.iter(f"{_TABLE}table-row"):
            cells: list[str | None] = []
            for c in r:
                if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                    continue
                kind = c.get(f"{_OFFICE}value-type")
                text = "\n".join(_odf_text(p) for p in c.findall(f"{_TEXT}p")) or None
                if kind in ("float", "percentage", "currency"):
                    x = float(c.get(f"{_OFFICE}value", "nan"))
                    text = str(int(x)) if x == x and abs(x) < 1e15 and x == int(x) else repr(x)
                elif kind == "date":
                    text = c.get(f"{_OFFICE}date-value", "").replace("T", " ") or text
                elif kind == "boolean":
                    text = c.get(f"{_OFFICE}boolean-value", text)
                n = int(c.get(f"{_TABLE}number-columns-repeated", "1"))
                cells += [text] * (n if text is not None or n < 1000 else 1)
            while cells and cells[-1] is None:
                cells.pop()
            n = int(r.get(f"{_TABLE}number-rows-repeated", "1"))
            rows += [cells] * (n if cells else min(n, 1))
        if any(rows):
            out.append((t.get(f"{_TABLE}name"), rows))
    return out
