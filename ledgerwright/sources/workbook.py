"""Workbooks as a Spark source and sink, in parts: no task and no driver holds a whole sheet.

Reading, partitions are ranges of a sheet's inflated bytes, planned from the archive's
directory. A task inflates the sheet up to its range, counts the rows it passes, parses
those that begin inside, and then looks up the shared strings they name in one pass.

Writing, tasks deflate the XML of their rows into pieces that end on a byte boundary; the
commit puts pieces one after the other into as many sheets as the format's row limit asks
for and closes the archive. Pieces lie in a folder of their own until then.
"""

from __future__ import annotations

import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..errors import IngestError
from .grids import Workbook, _tag, row_cells, shared_text, workbook_of
from .sniff import Limits

SCHEMA = "table_no int, table_name string, row_no int, cells array<string>"
#: Inflated bytes of a sheet that one task parses.
RANGE_BYTES = 16 << 20
#: Rows of a sheet, its header included, that spreadsheets open.
SHEET_ROWS = 1_048_576
#: Rows of one deflated piece.
PIECE_ROWS = 50_000
_ROW = re.compile(rb"<(?:[A-Za-z_][\w.-]*:)?row[\s/>]")
_CLOSING = re.compile(rb"</(?:[A-Za-z_][\w.-]*:)?sheetData")


def _store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path
    return arrow_fs.FileSystem.from_uri(path)


def _open(path: str) -> zipfile.ZipFile:
    """The archive at path; only its directory is read, names and sizes are checked by it."""
    store, at = _store(path)
    try:
        return zipfile.ZipFile(store.open_input_file(at))
    except zipfile.BadZipFile as e:
        raise IngestError("corrupt_file", "The archive cannot be opened.") from e


def _checked(archive: zipfile.ZipFile, size: int, limits: Limits) -> None:
    entries = archive.infolist()
    if len(entries) > limits.max_entries:
        raise IngestError("unsafe_archive", f"More than {limits.max_entries} entries.")
    for e in entries:
        if e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename) or ":" in e.filename:
            raise IngestError("unsafe_archive", f"The entry name {e.filename!r} leaves the archive.")
    if sum(e.file_size for e in entries) > limits.max_ratio * max(size, 1 << 16):
        raise IngestError("unsafe_archive", "The archive inflates to far more than its size.")


@dataclass
class Range(InputPartition):
    """Rows of a sheet that begin at inflated bytes low <= place < high."""

    table_no: int
    name: str
    part: str
    low: int
    high: int


def plan(path: str, limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> tuple[Workbook, list[Range]]:
    """The workbook and the ranges of its visible sheets. A directory that lies about a size ends a read there: an entry is never inflated beyond it."""
    store, at = _store(path)
    with _open(path) as archive:
        _checked(archive, store.get_file_info(at).size, limits)
        names = set(archive.namelist())
        for small in ("xl/workbook.xml", "xl/styles.xml", "xl/_rels/workbook.xml.rels"):
            if small in names and archive.getinfo(small).file_size > limits.max_unzipped:
                raise IngestError("unsafe_archive", f"{small} is too large.")
        book = workbook_of(lambda name: archive.read(name) if name in names else None, limits)
        ranges, n = [], 0
        for name, part in book.sheets:
            if part in names:
                size = max(1, archive.getinfo(part).file_size)
                ranges += [Range(n, name, part, low, min(low + range_bytes, size)) for low in range(0, size, range_bytes)]
                n += 1
        return book, ranges


def _no_entities(head: bytes) -> None:
    low = head.lower()
    if b"<!entity" in low or re.search(rb"<!doctype[^>]*\[", low):
        raise IngestError("unsafe_xml", "Entity definitions are not accepted.")


def _rows_in(file, low: int, high: int) -> Iterator[tuple[int, ET.Element]]:
    """(row number, element) of the rows that begin at low <= place < high of a sheet's XML, read to the end of the last one."""
    head = file.read(1 << 16)
    _no_entities(head)
    root = re.search(rb"<(?:[A-Za-z_][\w.-]*:)?worksheet\b[^>]*>", head)
    start = root[0].rstrip(b"/>") + b">" if root else b"<worksheet>"
    parser = ET.XMLPullParser(events=("start", "end"))
    parser.feed(start)
    held, place, number = head, 0, 0  # held: bytes from place on
    more = True
    feeding = False
    top = None
    keep = 256  # a row's tag may be cut by the end of a chunk
    while True:
        if not feeding:
            last = len(held) - (keep if more else 0)
            begin = None
            for m in _ROW.finditer(held):
                if m.start() >= last or place + m.start() >= high:
                    break
                if place + m.start() >= low:
                    begin = m.start()
                    break
                number += 1
            if begin is None:
                if place + max(last, 0) >= high:
                    return
                held, place = held[max(last, 0) :], place + max(last, 0)
            else:
                feeding, held, place = True, held[begin:], place + begin
        if feeding and held:
            # rows that begin at high or later are others'; what is before them belongs here
            stop = next((m.start() for m in _ROW.finditer(held) if place + m.start() >= high), None)
            closing = _CLOSING.search(held)
            if closing and (stop is None or closing.start() < stop):
                stop = closing.start()
            end = stop if stop is not None else max(0, len(held) - keep) if more else len(held)
            try:
                parser.feed(held[:end])
                for event, e in parser.read_events():
                    if event == "start" and top is None:
                        top = e
                    elif event == "end" and _tag(e) == "row":
                        yield number, e
                        number += 1
                        top.clear()  # parsing began inside sheetData, so rows are the children of top
            except ET.ParseError as e:
                raise IngestError("corrupt_file", "The markup is not well formed.") from e
            held, place = held[end:], place + end
            if stop is not None:
                return
        if more:
            chunk = file.read(1 << 18)
            more = bool(chunk)
            held += chunk
        elif not feeding or not held:
            return


def read_range(path: str, book: Workbook, part: Range, limits: Limits) -> tuple[list[int], list[list[str | None]]]:
    """Row numbers and cells of a range."""
    wanted: dict[int, str] = {}

    def note(i: int) -> str:
        wanted.setdefault(i, "")
        return f"\0{i}"  # no XML has this character: the place of a shared string

    numbers, rows = [], []
    with _open(path) as archive:
        with archive.open(part.part) as file:
            for number, row in _rows_in(file, part.low, part.high):
                if limits.max_rows is not None and number > limits.max_rows:
                    break
                numbers.append(number)
                rows.append(row_cells(row, book, note, limits))
        if wanted and "xl/sharedStrings.xml" in archive.namelist():
            last = max(wanted)
            with archive.open("xl/sharedStrings.xml") as file:
                head = file.read(1 << 16)
                _no_entities(head)
                parser, i, top = ET.XMLPullParser(events=("start", "end")), 0, None
                while head and i <= last:
                    parser.feed(head)
                    for event, e in parser.read_events():
                        if event == "start":
                            top = e if top is None else top
                        elif _tag(e) == "si":
                            if i in wanted:
                                wanted[i] = shared_text(e)
                            i += 1
                            top.clear()
                    head = file.read(1 << 18)
                known = i
        else:
            known = 0
    text = lambda v: v if v is None or not v.startswith("\0") else (wanted[int(v[1:])] if int(v[1:]) < known else v[1:])
    return numbers, [[None if (t := text(v)) is None else t[: limits.max_cell] for v in row] for row in rows]


class _Reader(DataSourceReader):
    def __init__(self, path: str, limits: Limits, range_bytes: int) -> None:
        self.path, self.limits = path, limits
        self.book, self.ranges = plan(path, limits, range_bytes)

    def partitions(self) -> list[Range]:
        return self.ranges or [Range(0, "", "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.part:
            return
        numbers, rows = read_range(self.path, self.book, partition, self.limits)
        for at in range(0, len(rows), 4096):
            n = len(rows[at : at + 4096])
            columns = [pa.array([partition.table_no] * n, pa.int32()), pa.array([partition.name] * n, pa.string()), pa.array(numbers[at : at + n], pa.int32()), pa.array(rows[at : at + n], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["table_no", "table_name", "row_no", "cells"])


# --- writing ---------------------------------------------------------------------


def crc_of_both(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings in a row from those of each and the length of the second: first is carried over length zero bytes."""

    def times(matrix: list[int], vector: int) -> int:
        out = 0
        for i in range(vector.bit_length()):
            if vector >> i & 1:
                out ^= matrix[i]
        return out

    step = [0xEDB88320] + [1 << i for i in range(31)]  # what one zero bit does to each bit of a checksum
    for _ in range(3):
        step = [times(step, x) for x in step]  # eight zero bits
    while length:
        if length & 1:
            first = times(step, first)
        step, length = [times(step, x) for x in step], length >> 1
    return first ^ second


def _cell(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f"<c><v>{value}</v></c>" if value == value and abs(value) != float("inf") else "<c/>"
    text = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n\r")
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _row(values: list) -> str:
    return f"<row>{''.join(map(_cell, values))}</row>"


@dataclass
class Piece:
    """Deflated rows in a file: where, how many rows, bytes and checksum of what they inflate to."""

    name: str
    rows: int
    size: int
    crc: int


@dataclass
class _Done(WriterCommitMessage):
    task: int
    pieces: list[Piece]


def _deflated(text: bytes) -> bytes:
    """text as deflate blocks that end on a byte boundary and are not the last: such pieces can stand in a row."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(text) + z.flush(zlib.Z_FULL_FLUSH)


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_MAIN, _REL, _PACKAGE = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, sheet: str, columns: list[str], overwrite: bool) -> None:
        self.path, self.sheet, self.columns, self.overwrite = path, sheet, columns, overwrite
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Done:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        task = TaskContext.get()
        pieces: list[Piece] = []
        held: list[str] = []

        def put() -> None:
            text = "".join(held).encode("utf-8", "replace")
            # the name tells attempts apart; only the pieces of the attempt that is committed are read
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(pieces):06d}"
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(_deflated(text))
            pieces.append(Piece(name, len(held), len(text), zlib.crc32(text)))
            held.clear()

        for batch in iterator:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(_row(list(values)))
                if len(held) >= PIECE_ROWS:
                    put()
        if held:
            put()
        return _Done(task.partitionId(), pieces)

    def commit(self, messages: list[_Done | None]) -> None:
        """Pieces in the order of partitions, in sheets of SHEET_ROWS at most; the archive takes its name when it is whole."""
        sheets: list[list[Piece]] = [[]]
        room = SHEET_ROWS - 1
        for piece in (p for m in sorted((m for m in messages if m), key=lambda m: m.task) for p in m.pieces):
            if piece.rows > room:
                sheets.append([])
                room = SHEET_ROWS - 1
            sheets[-1].append(piece)
            room -= piece.rows
        store, target = _store(self.path)
        if not self.overwrite and store.get_file_info(target).type != arrow_fs.FileType.NotFound:
            raise FileExistsError(self.path)
        _, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/whole") as out:
            self._archive(store, folder, out, sheets)
        store.move(f"{folder}/whole", target)
        store.delete_dir(folder)

    def _archive(self, store, folder: str, out, sheets: list[list[Piece]]) -> None:
        place, directory = 0, []

        def write(data: bytes) -> None:
            nonlocal place
            out.write(data)
            place += len(data)

        def entry(name: str, crc: int, packed: int, size: int) -> None:
            """A local header; sizes stand in it as 64-bit numbers, so that any sheet fits."""
            raw = name.encode()
            directory.append((raw, crc, packed, size, place))
            write(struct.pack("<4s5H3I2H", b"PK\x03\x04", 45, 0x800, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, size, packed))

        def small(name: str, text: str) -> None:
            raw = (_HEAD + text).encode()
            packed = _deflated(raw) + b"\x03\x00"
            entry(name, zlib.crc32(raw), len(packed), len(raw))
            write(packed)

        sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        numbers = range(1, len(sheets) + 1)
        names = [self.sheet[:31] if i == 1 else f"{self.sheet[: 30 - len(str(i))]} {i}" for i in numbers]
        small("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet}.worksheet+xml"/>' for i in numbers) + "</Types>")
        small("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        small("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True)) + "</sheets></workbook>")
        small("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        first = f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{_row(self.columns)}'.encode()
        last = b"</sheetData></worksheet>"
        for i, pieces in zip(numbers, sheets, strict=True):
            begin, end = _deflated(first), _deflated(last) + b"\x03\x00"
            crc, size, packed = zlib.crc32(first), len(first), len(begin) + len(end)
            for p in pieces:
                crc, size, packed = crc_of_both(crc, p.crc, p.size), size + p.size, packed + store.get_file_info(f"{folder}/{p.name}").size
            entry(f"xl/worksheets/sheet{i}.xml", crc_of_both(crc, zlib.crc32(last), len(last)), packed, size + len(last))
            write(begin)
            for p in pieces:  # copied some megabytes at a time
                with store.open_input_stream(f"{folder}/{p.name}") as file:
                    while data := file.read(4 << 20):
                        write(data)
            write(end)
        start = place
        for raw, crc, packed, size, at in directory:
            write(struct.pack("<4s6H3I5H2I", b"PK\x01\x02", 45, 45, 0x800, 8, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF) + raw + struct.pack("<2H3Q", 1, 24, size, packed, at))
        length, end = place - start, place
        write(struct.pack("<4sQ2H2I4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, len(directory), len(directory), length, start))
        write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        write(struct.pack("<4s4H2IH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))

    def abort(self, messages: list[_Done | None]) -> None:
        """Nothing stays of a write that failed."""
        store, folder = _store(self.folder)
        if store.get_file_info(folder).type != arrow_fs.FileType.NotFound:
            store.delete_dir(folder)


class WorkbookSource(DataSource):
    """format("workbook"): options path, range_bytes, sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        limits = Limits(**{k: int(v) for k, v in ((x, self.options.get(x)) for x in ("max_rows", "max_columns", "max_cell", "max_unzipped", "max_entries", "max_ratio", "max_sheets")) if v})
        return _Reader(self.options["path"], limits, int(self.options.get("range_bytes") or RANGE_BYTES))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("sheet") or "Data", schema.names, overwrite)


def read_workbook(spark: SparkSession, path: str, limits: Limits = Limits(), range_bytes: int = RANGE_BYTES) -> DataFrame:
    """table_no, table_name, row_no, cells of every row of a workbook's visible sheets, a task for each range of a sheet.

    path is a local path or a URI that Arrow's file systems know, seen by all executors.
    """
    spark.dataSource.register(WorkbookSource)
    options = {k: str(v) for k, v in (("max_rows", limits.max_rows), ("max_columns", limits.max_columns), ("max_cell", limits.max_cell), ("max_unzipped", limits.max_unzipped), ("max_entries", limits.max_entries), ("max_ratio", limits.max_ratio), ("max_sheets", limits.max_sheets), ("range_bytes", range_bytes)) if v is not None}
    return spark.read.format("workbook").options(**options).load(path)


def write_workbook(df: DataFrame, path: str, sheet: str = "Data", overwrite: bool = True) -> None:
    """df as one workbook file of values, of any number of rows: a header and the rows in the order of df's partitions, in several sheets beyond a sheet's limit.

    Numbers, booleans and text keep their types; dates, times and decimals are
    written as text; nulls, NaN and infinities are blank.
    """
    df.sparkSession.dataSource.register(WorkbookSource)
    plain = (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.FloatType)
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields]
    texts = df.select(*[c if isinstance(f.dataType, plain) else c.cast("string").alias(f.name) for c, f in zip(quoted, df.schema.fields, strict=True)])
    texts.write.format("workbook").option("sheet", sheet).mode("overwrite" if overwrite else "append").save(path)
