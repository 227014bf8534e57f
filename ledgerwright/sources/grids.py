"""Tables inside documents: workbooks, word-processor files, web pages and plain text.

Each parser turns the bytes of one file into named grids of text. document_rows()
runs a parser over any number of files, a file to a row, as a DataFrame of cells.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import IngestError
from .sniff import Limits, decode

Grid = tuple[str, list[list[str | None]]]


def open_zip(raw: bytes, limits: Limits = Limits()) -> dict[str, bytes]:
    """The entries of an archive; bombs, odd names and too many entries are refused while inflating."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
    except zipfile.BadZipFile as e:
        raise IngestError("corrupt_file", "The archive cannot be opened.") from e
    if len(archive.infolist()) > limits.max_entries:
        raise IngestError("unsafe_archive", f"More than {limits.max_entries} entries.")
    out, total = {}, 0
    for entry in archive.infolist():
        if entry.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", entry.filename) or ":" in entry.filename:
            raise IngestError("unsafe_archive", f"The entry name {entry.filename!r} leaves the archive.")
        with archive.open(entry) as file:
            parts = []
            while part := file.read(1 << 20):
                total += len(part)
                parts.append(part)
                if total > limits.max_unzipped or total > limits.max_ratio * max(len(raw), 1 << 16):
                    raise IngestError("unsafe_archive", "The archive inflates to far more than its size.")
        out[entry.filename] = b"".join(parts)
    return out


def safe_xml(raw: bytes) -> ET.Element:
    head = raw[:4096].lower()
    if b"<!entity" in raw.lower() or (b"<!doctype" in head and b"[" in head.split(b"<!doctype", 1)[1].split(b">", 1)[0]):
        raise IngestError("unsafe_xml", "Entity definitions are not accepted.")
    try:
        return ET.fromstring(raw)
    except ET.ParseError as e:
        raise IngestError("corrupt_file", "The markup is not well formed.") from e


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _find(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _tag(x) == name)


@dataclass(frozen=True)
class Workbook:
    """What a workbook says of all its sheets: the visible ones (name, part), which cell styles are dates, and the epoch."""

    sheets: tuple[tuple[str, str], ...]
    dated: frozenset[int]
    old_epoch: bool


def workbook_of(part: Callable[[str], bytes | None], limits: Limits = Limits()) -> Workbook:
    """The workbook whose parts part(name) gives; only its small parts are read."""
    book = safe_xml(part("xl/workbook.xml") or b"<workbook/>")
    dated: set[int] = set()
    if content := part("xl/styles.xml"):
        styles = safe_xml(content)
        custom = {x.get("numFmtId"): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode") or "") for x in _find(styles, "numFmt")}
        formats = next((list(x) for x in styles if _tag(x) == "cellXfs"), [])
        for i, x in enumerate(formats):
            n = x.get("numFmtId") or "0"
            if n.isdigit() and (14 <= int(n) <= 22 or 45 <= int(n) <= 47) or re.search(r"[ymd]", custom.get(n, ""), re.I):
                dated.add(i)
    links = {x.get("Id"): x.get("Target") for x in safe_xml(part("xl/_rels/workbook.xml.rels") or b"<r/>")}
    old_epoch = any(x.get("date1904") in ("1", "true") for x in _find(book, "workbookPr"))
    sheets = []
    for i, sheet in enumerate(list(_find(book, "sheet"))[: limits.max_sheets]):
        if sheet.get("state") in ("hidden", "veryHidden"):
            continue
        target = links.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), f"worksheets/sheet{i + 1}.xml") or ""
        sheets.append((sheet.get("name") or f"Sheet{i + 1}", target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return Workbook(tuple(sheets), frozenset(dated), old_epoch)


def shared_text(item: ET.Element) -> str:
    """The text of an entry of the shared strings."""
    return "".join(t.text or "" for t in _find(item, "t"))


def row_cells(row: ET.Element, book: Workbook, shared: Callable[[int], str | None], limits: Limits = Limits()) -> list[str | None]:
    """The cells of a row element: cached values, civil dates for date formats, errors as blanks; shared(i) gives a shared string."""
    cells: list[str | None] = []
    for c in (x for x in row if _tag(x) == "c"):
        place = re.match(r"[A-Z]+", c.get("r") or "")
        at = len(cells)
        if place:
            at = 0
            for letter in place[0]:
                at = at * 26 + ord(letter) - 64
            at -= 1
        if at >= limits.max_columns:
            break
        cells += [None] * (at - len(cells))
        value = next((x.text for x in c if _tag(x) == "v"), None)
        kind = c.get("t")
        if kind == "s" and value and value.isdigit():
            text = shared(int(value))
            value = value if text is None else text
        elif kind == "inlineStr":
            value = "".join(t.text or "" for t in _find(c, "t"))
        elif kind == "b":
            value = "true" if value == "1" else "false"
        elif kind == "e":
            value = None
        elif value and kind is None and (c.get("s") or "").isdigit() and int(c.get("s")) in book.dated:
            try:
                day = date(1904, 1, 1) if book.old_epoch else date(1899, 12, 30)
                value = (day + timedelta(days=int(float(value)))).isoformat()
            except (ValueError, OverflowError):
                pass
        cells.append(value)
    return cells


def xlsx_grids(raw: bytes, limits: Limits = Limits()) -> list[Grid]:
    """Every visible sheet of a workbook in memory; sources.workbook reads large ones in parts."""
    entries = open_zip(raw, limits)
    book = workbook_of(entries.get, limits)
    strings = [shared_text(si) for si in safe_xml(entries["xl/sharedStrings.xml"]) if _tag(si) == "si"] if "xl/sharedStrings.xml" in entries else []
    out: list[Grid] = []
    for name, part in book.sheets:
        content = entries.get(part)
        if content is None:
            continue
        grid: list[list[str | None]] = []
        for row in _find(safe_xml(content), "row"):
            grid.append(row_cells(row, book, lambda i: strings[i] if i < len(strings) else None, limits))
            if limits.max_rows is not None and len(grid) > limits.max_rows:
                break
        out.append((name, grid))
    return out


def docx_blocks(raw: bytes, limits: Limits = Limits()) -> tuple[list[Grid], list[tuple[str, str]]]:
    """Tables, and (heading | paragraph, text) blocks in reading order."""
    body = next(_find(safe_xml(open_zip(raw, limits).get("word/document.xml") or b"<d/>"), "body"), None)
    tables: list[Grid] = []
    blocks: list[tuple[str, str]] = []
    for e in body if body is not None else []:
        if _tag(e) == "p":
            text = "".join(t.text or "" for t in _find(e, "t")).strip()
            style = next((v for s in _find(e, "pStyle") for k, v in s.attrib.items() if k.endswith("val")), "")
            if text:
                blocks.append(("heading" if style.lower().startswith(("heading", "title")) else "paragraph", text))
        elif _tag(e) == "tbl":
            grid = []
            for row in (x for x in e if _tag(x) == "tr"):
                cells: list[str | None] = []
                for c in (x for x in row if _tag(x) == "tc"):
                    span = next((v for s in _find(c, "gridSpan") for k, v in s.attrib.items() if k.endswith("val")), "1")
                    cells += [" ".join("".join(t.text or "" for t in _find(p, "t")) for p in _find(c, "p")).strip()] + [None] * (int(span) - 1 if span.isdigit() else 0)
                grid.append(cells)
            heading = next((t for kind, t in reversed(blocks) if kind == "heading"), None)
            tables.append((heading or f"Table {len(tables) + 1}", grid))
    return tables, blocks


class _Tables(HTMLParser):
    """Tables with spans expanded, named by caption or the heading before; headings and paragraphs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[Grid] = []
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[dict] = []
        self.text: list[str] | None = None
        self.kind, self.skip, self.heading = "", 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "template", "noscript"):
            self.skip += 1
        elif tag == "table":
            self.stack.append({"rows": [], "spans": {}, "caption": "", "cell": None})
        elif tag == "tr" and self.stack:
            self.stack[-1]["rows"].append([])
        elif tag in ("td", "th") and self.stack:
            t = self.stack[-1]
            if not t["rows"]:
                t["rows"].append([])
            number = lambda v: min(1000, int(v)) if (v or "").isdigit() and int(v) else 1
            t["cell"] = ([], number(a.get("colspan")), number(a.get("rowspan")))
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "caption"):
            self._end_text()
            self.kind, self.text = tag, []
        elif tag == "br":
            self.handle_data(" ")

    def _end_text(self) -> None:
        if self.text is None:
            return
        text = " ".join("".join(self.text).split())
        if text and self.kind == "caption" and self.stack:
            self.stack[-1]["caption"] = text
        elif text and not self.stack:
            heading = self.kind.startswith("h")
            self.heading = text if heading else self.heading
            self.blocks.append(("heading" if heading else "paragraph", text))
        self.text = None

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template", "noscript"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th") and self.stack and self.stack[-1]["cell"]:
            t = self.stack[-1]
            parts, across, down = t["cell"]
            text, row, i = " ".join("".join(parts).split()), len(t["rows"]) - 1, len(t["rows"][-1])
            while (row, i) in t["spans"]:
                t["rows"][-1].append(t["spans"][row, i])
                i += 1
            for k in range(across):
                t["rows"][-1].append(text)
                for d in range(1, down):
                    t["spans"][row + d, i + k] = text
            t["cell"] = None
        elif tag == "table" and self.stack:
            t = self.stack.pop()
            for n, row in enumerate(t["rows"]):
                while (n, len(row)) in t["spans"]:
                    row.append(t["spans"][n, len(row)])
            rows = [r for r in t["rows"] if r]
            if rows:
                self.tables.append((t["caption"] or self.heading or f"Table {len(self.tables) + 1}", rows))
        elif tag == self.kind:
            self._end_text()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.text is not None:
            self.text.append(data)
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][0].append(data)


def html_blocks(raw: bytes) -> tuple[list[Grid], list[tuple[str, str]]]:
    parser = _Tables()
    parser.feed(decode(raw)[0])
    parser.close()
    parser._end_text()
    return parser.tables, parser.blocks


def text_blocks(raw: bytes) -> list[tuple[str, str]]:
    """Paragraphs of plain text; short lines of capitals are headings."""
    out = []
    for part in re.split(r"\n\s*\n", decode(raw)[0].replace("\r\n", "\n")):
        text = " ".join(part.split())
        if text:
            out.append(("heading" if len(text) <= 80 and text.isupper() and "\n" not in part.strip() else "paragraph", text))
    return out


def key_values(lines: list[str], most: int = 200) -> list[tuple[str, str]]:
    """Key: value and key .... value pairs of text lines, each key once."""
    out: dict[str, str] = {}
    for line in lines:
        m = re.match(r"^\s*([A-Za-z][\w /#&()'-]{0,60}?)\s*(?::\s+|\.{3,}\s*)(\S.{0,300})$", line)
        if m and m[1].strip() not in out and len(out) < most:
            out[m[1].strip()] = m[2].strip()
    return list(out.items())


def group_lines(items: list[tuple[float, float, str]], tolerance: float = 3.0) -> list[list[tuple[float, str]]]:
    """Positioned texts (x, y, text) as lines from top to bottom, each ordered by x."""
    lines: list[tuple[float, list[tuple[float, str]]]] = []
    for x, y, t in sorted(items, key=lambda i: (-i[1], i[0])):
        if lines and abs(lines[-1][0] - y) <= tolerance:
            lines[-1][1].append((x, t))
        else:
            lines.append((y, [(x, t)]))
    return [sorted(cells) for _, cells in lines]


def find_tables(lines: list[list[tuple[float, str]]], tolerance: float = 8.0) -> list[Grid]:
    """Runs of at least three lines with two or more cells whose starts are aligned."""
    out: list[Grid] = []
    run: list[list[tuple[float, str]]] = []
    for line in [*lines, []]:
        if run and len(line) >= 2 and len(line) == len(run[0]) and all(abs(a[0] - b[0]) <= tolerance for a, b in zip(line, run[0], strict=True)):
            run.append(line)
            continue
        if len(run) >= 3:
            out.append((f"Table {len(out) + 1}", [[t for _, t in x] for x in run]))
        run = [line] if len(line) >= 2 else []
    return out


def document_rows(spark: SparkSession, path: str, parse: Callable[[bytes], list[Grid]], limits: Limits = Limits()) -> DataFrame:
    """path, table_no, table_name, row_no, cells of every table of every file under path; a file that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    schema = "path string, table_no int, table_name string, row_no int, cells array<string>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, content in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                try:
                    if limits.max_bytes is not None and size > limits.max_bytes:
                        raise IngestError("file_too_large", f"More than {limits.max_bytes >> 20} MB.")
                    for t, (title, grid) in enumerate(parse(content.as_py())):
                        rows += [(name, t, title, i, [None if c is None else str(c)[: limits.max_cell] for c in row], None) for i, row in enumerate(grid)]
                except IngestError as e:
                    rows = [(name, None, None, None, None, f"{e.code}: {e.message}")]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "table_no", "table_name", "row_no", "cells", "error"])

    return files.mapInArrow(run, schema)
