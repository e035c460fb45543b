"""Spreadsheets and word documents to Markdown, read as streams of XML from their zip files.

A sheet becomes a heading and a line for each row that isn't blank, its cells between bars. A document becomes headings, paragraphs, list items
and tables. Cells hold what the file stores: a formula's last value, and of merged cells the first of a sheet, while a document's merged cells repeat their text.
A file that isn't what it should be is an error of the caller's row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

#: Namespaces, and numbers of the built-in formats that are dates or times.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _parts(book: zipfile.ZipFile, name: str) -> Iterator[tuple[str, ElementTree.Element]]:
    """(event, element) of a part, with what is done with taken off the tree by the caller."""
    with book.open(name) as part:
        yield from ElementTree.iterparse(part, ("start", "end"))


def _tree(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(book.read(name)) if name in book.namelist() else None


def _joined(element: ElementTree.Element) -> str:
    """The text of a string item: its own or its runs', without phonetic hints."""
    out = []
    for child in element:
        kind = _local(child.tag)
        if kind == "t":
            out.append(child.text or "")
        elif kind == "r":
            out += [t.text or "" for t in child if _local(t.tag) == "t"]
    return "".join(out)


def _shared(book: zipfile.ZipFile) -> list[str]:
    found: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for event, e in _parts(book, "xl/sharedStrings.xml"):
            if event == "end" and _local(e.tag) == "si":
                found.append(_joined(e))
                e.clear()
    return found


def _is_date(code: str) -> bool:
    """Whether a number format shows a date or a time: it has their letters outside quotes, escapes and brackets (but for counted hours, minutes and seconds)."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.', "", code)
    bare = re.sub(r"\[(?!(?:h+|m+|s+)\])[^\]]*\]", "", bare, flags=re.I)
    return bool(re.search(r"[dmhys]", bare.split(";")[0], re.I)) and "general" not in bare.lower()


def _styles(book: zipfile.ZipFile) -> list[tuple[bool, bool]]:
    """(is a date, is a span of time) by cell style."""
    tree = _tree(book, "xl/styles.xml")
    if tree is None:
        return []
    codes = {int(f.get("numFmtId", 0)): f.get("formatCode", "") for f in tree.iter(f"{_MAIN}numFmt")}
    cells = tree.find(f"{_MAIN}cellXfs")
    out = []
    for style in cells if cells is not None else []:
        number = int(style.get("numFmtId", 0))
        code = codes.get(number, "")
        span = bool(re.search(r"\[(h+|m+|s+)\]", code, re.I)) or number == 46
        out.append((number in _DATE_FORMATS or _is_date(code), span))
    return out


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n


def _moment(days: float, old: bool, span: bool) -> object:
    if span:
        return timedelta(days=days)
    whole = timedelta(seconds=round(days * 86400, 3))
    if 0 <= days < 1:
        return (datetime(1900, 1, 1) + whole).time()
    if old:
        return datetime(1904, 1, 1) + whole
    return datetime(1899, 12, 30) + whole + timedelta(days=1 if days < 60 else 0)  # the calendar of 1900 has a 29 February too many


def _value(cell: ElementTree.Element, shared: list[str], styles: list[tuple[bool, bool]], old: bool) -> object:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_MAIN}v")
    if kind == "inlineStr":
        inside = cell.find(f"{_MAIN}is")
        return _joined(inside) if inside is not None else None
    if raw is None:
        return None
    if kind == "s":
        return shared[int(raw)]
    if kind == "b":
        return raw.strip() == "1"
    if kind == "d":
        return datetime.fromisoformat(raw)
    if kind in ("str", "e"):
        return raw
    number = float(raw) if re.search(r"[.eE]", raw) else int(raw)
    style = int(cell.get("s", 0))
    date, span = styles[style] if style < len(styles) else (False, False)
    return _moment(float(number), old, span) if date or span else number


def sheet_markdown(data: bytes) -> str:
    """Sheets in the book's order: a heading with the title and a line for each row with text, cells between bars, as wide as the sheet says it is."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        tree = ElementTree.fromstring(book.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        properties = tree.find(f"{_MAIN}workbookPr")
        old = properties is not None and properties.get("date1904", "0") in ("1", "true")
        shared, styles, lines = _shared(book), _styles(book), []
        for sheet in tree.iter(f"{_MAIN}sheet"):
            target = links[sheet.get(_LINK)]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if "worksheets/" not in name:  # charts
                continue
            lines.append(f"## {sheet.get('name')}")
            lines += _sheet_lines(book, name, shared, styles, old)
    return "\n".join(lines)


def _sheet_lines(book: zipfile.ZipFile, name: str, shared: list[str], styles: list[tuple[bool, bool]], old: bool) -> Iterator[str]:
    width, rows = None, None
    for event, e in _parts(book, name):
        kind = _local(e.tag)
        if event == "start":
            if kind == "sheetData":
                rows = e
            continue
        if kind == "dimension" and ":" in e.get("ref", ""):
            width = _column(e.get("ref").split(":")[1]) or None
        elif kind == "row":
            cells: dict[int, object] = {}
            for c in e:
                at = _column(c.get("r", "")) or max(cells, default=0) + 1
                cells[at] = _value(c, shared, styles, old)
            wide = width or max(cells, default=0)
            texts = ["" if cells.get(i) is None else str(cells[i]) for i in range(1, wide + 1)]
            if any(t.strip() for t in texts):
                yield " | ".join(texts)
            if rows is not None:
                rows.clear()  # rows are done with one by one


# --- word documents ---


def _words(paragraph: ElementTree.Element) -> str:
    out = []
    for e in paragraph.iter():
        kind = _local(e.tag)
        if kind == "t":
            out.append(e.text or "")
        elif kind == "tab" and e.get(f"{_WORD}val") is None:
            out.append("\t")
        elif kind in ("br", "cr"):
            out.append("\n")
    return "".join(out).strip()


def _heading_levels(book: zipfile.ZipFile) -> dict[str, int]:
    """Levels of heading styles by their id: 0 for a title; a style may take its level from the one it is based on."""
    tree = _tree(book, "word/styles.xml")
    styles = {s.get(f"{_WORD}styleId"): s for s in tree.iter(f"{_WORD}style")} if tree is not None else {}
    found: dict[str, int] = {}
    for id in styles:
        at, seen = id, set()
        while at in styles and at not in seen:
            seen.add(at)
            style = styles[at]
            name = style.find(f"{_WORD}name")
            said = (name.get(f"{_WORD}val", "") if name is not None else "").lower()
            outline = style.find(f"{_WORD}pPr/{_WORD}outlineLvl")
            if said == "title":
                found[id] = 0
            elif m := re.fullmatch(r"heading (\d)", said):
                found[id] = int(m[1])
            elif outline is not None:
                found[id] = int(outline.get(f"{_WORD}val")) + 1
            if id in found:
                break
            based = style.find(f"{_WORD}basedOn")
            at = based.get(f"{_WORD}val") if based is not None else None
    return found


def _paragraph(p: ElementTree.Element, levels: dict[str, int]) -> tuple[str, str]:
    """(kind, text)"""
    text = _words(p)
    style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
    id = style.get(f"{_WORD}val", "") if style is not None else ""
    level = levels.get(id)
    if level is None and (m := re.fullmatch(r"Heading(\d)", id)):
        level = int(m[1])
    if level is not None and text:
        return "heading", f"{'#' * min(6, level + 1)} {' '.join(text.split())}"
    if text and (p.find(f"{_WORD}pPr/{_WORD}numPr") is not None or id.startswith("List")):
        return "item", f"- {text}"
    return "text", text


def _table(table: ElementTree.Element) -> str:
    """A table's rows; a cell over several columns or rows repeats its text in each."""
    rows: list[list[str]] = []
    for row in table.findall(f"{_WORD}tr"):
        cells: list[str] = []
        for cell in row.findall(f"{_WORD}tc"):
            about = cell.find(f"{_WORD}tcPr")
            span = about.find(f"{_WORD}gridSpan") if about is not None else None
            merged = about.find(f"{_WORD}vMerge") if about is not None else None
            text = " ".join(" ".join(_words(p) for p in cell.iter(f"{_WORD}p")).split()).replace("|", "\\|")
            for _ in range(int(span.get(f"{_WORD}val", 1)) if span is not None else 1):
                goes_on = merged is not None and merged.get(f"{_WORD}val") != "restart"
                cells.append(rows[-1][len(cells)] if goes_on and rows and len(cells) < len(rows[-1]) else text)
        rows.append(cells)
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def document_markdown(data: bytes) -> str:
    """The body in order: headings a level below the title's, paragraphs and tables apart from one another, list items line by line."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        levels, blocks, depth = _heading_levels(book), [], 0
        last, body = "", None
        for event, e in _parts(book, "word/document.xml"):
            kind = _local(e.tag)
            if event == "start":
                body = e if kind == "body" else body
                depth += kind == "tbl"
                continue
            if kind == "tbl":
                depth -= 1
                if not depth and (text := _table(e)):
                    blocks.append(text)
                    last = "table"
            elif kind == "p" and not depth:
                what, text = _paragraph(e, levels)
                if text and what == "item" == last:
                    blocks[-1] += f"\n{text}"
                elif text:
                    blocks.append(text)
                last = what if text else last
            if body is not None and not depth and kind in ("tbl", "p") and e in list(body)[-1:]:
                body.clear()
    return "\n\n".join(blocks)
