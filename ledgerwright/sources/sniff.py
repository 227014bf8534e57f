"""What a file is, from its first bytes: format, encoding, delimiter, columns, header."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from ..errors import IngestError

HEAD_BYTES = 1 << 16
DELIMITERS = (",", "\t", ";", "|")


@dataclass(frozen=True)
class Limits:
    """What one ingestion may take; more is refused or cut with a warning.

    Bytes and rows are unlimited unless asked for (see UPLOADS): delimited, JSON and
    Parquet files are read by Spark however large they are.
    """

    max_bytes: int | None = None
    max_rows: int | None = None
    max_columns: int = 500
    max_cell: int = 32_768
    max_unzipped: int = 400 << 20
    max_entries: int = 5_000
    max_ratio: int = 200
    max_sheets: int = 50


#: Limits for files that strangers hand in.
UPLOADS = Limits(max_bytes=50 << 20, max_rows=1_000_000)


def sniff_format(head: bytes, name: str = "") -> str:
    """csv, tsv, json, ndjson, xml, html, xlsx, docx, xls, pdf, parquet or text; the content decides, the name breaks ties."""
    if not head:
        raise IngestError("empty_file", "The file is empty.")
    ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if head.startswith(b"PK\x03\x04"):
        kind = "xlsx" if b"xl/" in head or ext in ("xlsx", "xlsm") else "docx" if b"word/" in head or ext == "docx" else ""
        if not kind:
            raise IngestError("unsupported_format", "An archive that is neither a workbook nor a document.")
        return kind
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        return "xls"
    if head.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"PAR1"):
        return "parquet"
    text = decode(head)[0]
    if text.count("\x00") > 0 or sum(c < " " and c not in "\t\r\n\f\x1b" for c in text[:4096]) > 0.05 * max(1, len(text[:4096])):
        raise IngestError("binary_file", "The file is not text and not a known format.")
    t = text.lstrip("﻿ \t\r\n")
    low = t[:2000].lower()
    if re.match(r"<!doctype html|<html|<(?:head|body|table|div)\b", low):
        return "html"
    if t.startswith("<?xml") or low.startswith("<!doctype") or re.match(r"<[a-z_][\w.:-]*[\s>/]", low):
        return "html" if "<html" in low else "xml"
    if t[:1] in "{[":
        lines = [x for x in t.split("\n")[:5] if x.strip()]
        if t.startswith("{") and len(lines) > 1 and all(x.strip().startswith("{") for x in lines[:2]) and lines[0].rstrip().endswith("}"):
            return "ndjson"
        return "ndjson" if ext in ("ndjson", "jsonl") else "json"
    found = detect_delimiter(text, "\t" if ext == "tsv" else None)
    if found:
        return "tsv" if found == "\t" else "csv"
    return "csv" if ext == "csv" else "text"


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): byte-order mark, UTF-16 by its zero bytes, UTF-8, else Windows-1252."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(encoding, "replace"), encoding
    part = raw[:2000]
    if len(part) > 3:
        even, odd = part[0::2].count(0), part[1::2].count(0)
        if odd > 0.3 * len(part) / 2 and even < odd / 4:
            return raw.decode("utf-16-le", "replace"), "utf-16-le"
        if even > 0.3 * len(part) / 2 and odd < even / 4:
            return raw.decode("utf-16-be", "replace"), "utf-16-be"
    try:
        return raw.decode("utf-8"), "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(raw) - 3:  # cut inside the last character
            return raw[: e.start].decode("utf-8"), "utf-8"
        return raw.decode("windows-1252", "replace"), "windows-1252"


def count_fields(text: str, delimiter: str) -> int:
    """The most fields that a line of text has; delimiters inside quotes do not count."""
    return max((x.count(delimiter) + 1 for x in re.sub(r'"(?:[^"]|"")*"', "q", text).split("\n")), default=1)


def detect_delimiter(text: str, preferred: str | None = None) -> str | None:
    """The delimiter that gives the most lines one and the same number of fields (three fifths at least), or None."""
    bare = re.sub(r'"(?:[^"]|"")*"', "q", text.replace("\r\n", "\n"))  # delimiters and line ends inside quotes do not count
    lines = [x for x in bare.split("\n")[:60] if x.strip()]
    best, score = None, 0.0
    for d in DELIMITERS:
        counts = Counter(x.count(d) + 1 for x in lines)
        common, n = max(((c, n) for c, n in counts.items() if c > 1), key=lambda cn: (cn[1], cn[0]), default=(1, 0))
        own = n / len(lines) + min(common, 20) / 1000 + (0.05 if d == preferred else 0)
        if n / max(1, len(lines)) >= 0.6 and own > score and (len(lines) > 1 or common > 1):
            best, score = d, own
    return best


def detect_fixed_width(text: str) -> list[tuple[int, int]] | None:
    """Column spans of text aligned by spaces: a gap is blank in every line. None unless it looks like a table."""
    lines = [x.rstrip().expandtabs() for x in text.split("\n")[:200] if x.strip()]
    if len(lines) < 3:
        return None
    width = max(map(len, lines))
    used = [any(i < len(x) and x[i] != " " for x in lines) for i in range(width)]
    spans, start = [], None
    for i, u in enumerate([*used, False, False]):
        if u and start is None:
            start = i
        elif not u and start is not None and not (i + 1 < width and used[i + 1] and i - start < 1):
            spans.append((start, i))
            start = None
    cells = [[x[a:b].strip() for a, b in spans] for x in lines]
    flat = [c for row in cells for c in row]
    filled = [c for c in flat if c]
    if len(spans) < 2 or len(filled) < 0.6 * len(flat) or sum(map(len, filled)) / len(filled) > 40:
        return None
    return spans


def header_row(grid: list[list[str | None]], scan: int = 30) -> int | None:
    """Index of the header among the first rows: the first dense row of distinct words; None if data come at once."""
    width = max((len(r) for r in grid[:200]), default=0)
    for i, row in enumerate(grid[:scan]):
        cells = [str(c).strip() for c in row if c is not None and str(c).strip()]
        if len(cells) < max(1, 0.6 * width):
            continue
        numeric = sum(bool(re.fullmatch(r"[$€£(+-]?[\d.,:/ -]+[%)]?", c)) for c in cells)
        return i if numeric == 0 and len(set(c.lower() for c in cells)) >= 0.5 * len(cells) else None
    return None


def column_names(cells: list[str | None], width: int) -> list[str]:
    """Headers with single spaces, at most 200 characters; blanks become column_N, repeats get _2, _3."""
    out: list[str] = []
    seen: Counter[str] = Counter()
    for i in range(width):
        name = re.sub(r"\s+", " ", str(cells[i] if i < len(cells) and cells[i] is not None else "")).strip()[:200] or f"column_{i + 1}"
        seen[name.lower()] += 1
        while seen[name.lower()] > 1 and f"{name}_{seen[name.lower()]}".lower() in seen:
            seen[name.lower()] += 1
        out.append(name if seen[name.lower()] == 1 else f"{name}_{seen[name.lower()]}")
        seen[out[-1].lower()] += out[-1] != name
    return out
