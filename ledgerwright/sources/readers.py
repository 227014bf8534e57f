"""Files of many formats as DataFrames of text columns with a stable row id."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import IngestError
from ..session import written
from . import grids
from .sniff import HEAD_BYTES, Limits, column_names, count_fields, decode, detect_delimiter, detect_fixed_width, header_row, sniff_format
from .workbook import plan, read_workbook

ROW_ID = "__row_id"
_C1 = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


@dataclass
class RawTable:
    """An untyped table: text columns (numbers and booleans where the format has them) and ROW_ID."""

    name: str
    df: DataFrame
    n_rows: int
    columns: list[str]


@dataclass
class Ingested:
    format: str
    tables: list[RawTable]
    blocks: list[tuple[str, str]] = field(default_factory=list)
    key_values: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def _numbered(df: DataFrame) -> DataFrame:
    """Row ids that ascend in file order (one file: partition by partition)."""
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def _cell(c: Column, limits: Limits) -> Column:
    return F.substring(c, 1, limits.max_cell)


def _table(name: str, raw: DataFrame, limits: Limits, warnings: list[str]) -> RawTable:
    """Names from the header row, title rows above it gone, limits kept."""
    columns = [c for c in raw.columns if c != ROW_ID][: limits.max_columns]
    if len(raw.columns) - 1 > limits.max_columns:
        warnings.append(f"Only the first {limits.max_columns} columns were read.")
    first = raw.orderBy(ROW_ID).limit(200).collect()
    grid = [[r[c] for c in columns] for r in first]
    at = header_row(grid)
    names = column_names([None if v is None else str(v) for v in grid[at]] if at is not None else [], len(columns))
    out = raw.select(*[_cell(F.col(f"`{c}`"), limits).alias(n) for c, n in zip(columns, names, strict=True)], ROW_ID)
    if at is not None:
        if at:
            warnings.append(f"{at} title row(s) above the header were skipped.")
        out = out.where(F.col(ROW_ID) > first[at][ROW_ID])
    n = out.count()
    if limits.max_rows is not None and n > limits.max_rows:
        warnings.append(f"Only the first {limits.max_rows:,} rows were read.")
        out, n = out.orderBy(ROW_ID).limit(limits.max_rows), limits.max_rows
    return RawTable(name, out, n, names)


def read_delimited(spark: SparkSession, path: str, delimiter: str, encoding: str = "utf-8", width: int = 1) -> DataFrame:
    """Every cell of width columns as text; ragged rows are padded."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    latin = encoding == "windows-1252"  # which Spark reads as its near relative; the 27 characters that differ are put right
    out = spark.read.schema(schema).csv(path, sep=delimiter, quote='"', escape='"', multiLine=True, header=False, mode="PERMISSIVE", inferSchema=False, encoding="ISO-8859-1" if latin else encoding.replace("utf-16-", "utf-16"), ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="")
    if latin:
        out = out.select(*[F.translate(c, _C1, _C1.encode("latin-1").decode("windows-1252")).alias(c) for c in out.columns])
    return _numbered(out)


def read_fixed_width(spark: SparkSession, path: str, spans: list[tuple[int, int]]) -> DataFrame:
    lines = _numbered(spark.read.text(path)).where(F.length(F.trim("value")) > 0)
    last = len(spans) - 1
    cut = [F.trim(F.substring("value", a + 1, (1 << 20) if i == last else b - a)).alias(f"c{i}") for i, (a, b) in enumerate(spans)]
    return lines.select(*cut, ROW_ID)


def flatten(df: DataFrame, depth: int = 5) -> DataFrame:
    """Nested records as dotted columns; lists of plain values joined by "; ", deeper lists as JSON text."""

    def walk(c: Column, kind: T.DataType, name: str, left: int) -> list[Column]:
        if isinstance(kind, T.StructType) and left:
            return [x for f in kind.fields for x in walk(c.getField(f.name), f.dataType, f"{name}.{f.name}" if name else f.name, left - 1)]
        if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return [F.concat_ws("; ", c.cast("array<string>")).alias(name)]
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return [F.substring(F.to_json(c), 1, 2000).alias(name)]
        return [c.alias(name)]

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name, depth)])


def record_path(kind: T.DataType, path: tuple[str, ...] = (), depth: int = 6) -> list[tuple[tuple[str, ...], int]]:
    """Paths of lists of records in a schema, with their number of fields."""
    if isinstance(kind, T.StructType) and depth:
        return [x for f in kind.fields for x in record_path(f.dataType, (*path, f.name), depth - 1)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return [(path, len(kind.elementType.fields))]
    return []


def read_json(spark: SparkSession, path: str, lines: bool = False, warnings: list[str] | None = None) -> DataFrame:
    """Records of a JSON file: a list, lists of lists, an envelope, a keyed object, one object or a line each."""
    df = spark.read.json(path, multiLine=not lines, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    if "_corrupt" in df.columns:
        only_bad = set(df.columns) == {"_corrupt"}
        df = df.cache()  # Spark asks for this before the bad lines alone may be counted
        bad = 0 if only_bad else df.where("_corrupt is not null").count()
        if not lines or only_bad:
            grid = _list_of_lists(spark, path) if not lines else None
            if grid is None:
                raise IngestError("corrupt_file", "The file is not valid JSON.")
            return grid
        if bad and warnings is not None:
            warnings.append(f"{bad} line(s) could not be read and were skipped.")
        df = df.where("_corrupt is null").drop("_corrupt")
    if not lines:
        found = record_path(df.schema)
        if found:
            size = {p: F.sum(F.coalesce(F.size(F.col(".".join(f"`{x}`" for x in p))), F.lit(0))).alias(f"s{i}") for i, (p, _) in enumerate(found)}
            row = df.agg(*size.values()).first()
            best = max(range(len(found)), key=lambda i: (row[f"s{i}"] or 0) * (1 + min(10, found[i][1]) / 10))
            if df.count() == 1 and (row[f"s{best}"] or 0) > 0:
                return _numbered(flatten(df.select(F.explode(F.col(".".join(f"`{x}`" for x in found[best][0]))).alias("r")).select("r.*")))
        fields = df.schema.fields
        if len(fields) > 1 and all(isinstance(f.dataType, T.StructType) for f in fields) and df.count() == 1:
            parts = [df.select(F.lit(f.name).alias("key"), F.col(f"`{f.name}`").alias("r")).select("key", "r.*") for f in fields]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p, allowMissingColumns=True)
            return _numbered(flatten(out))
    return _numbered(flatten(df))


def _list_of_lists(spark: SparkSession, path: str) -> DataFrame | None:
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("r"))
    width = rows.agg(F.max(F.size("r"))).first()[0]
    return _numbered(rows.select(*[F.get("r", i).alias(f"c{i}") for i in range(width)])) if width else None


def read_xml(spark: SparkSession, path: str, head: str) -> DataFrame:
    """The repeating element of an XML file as rows; entity definitions are refused."""
    low = head.lower()
    if "<!entity" in low or re.search(r"<!doctype[^>]*\[", low):
        raise IngestError("unsafe_xml", "Entity definitions are not accepted.")
    tags = re.findall(r"<([A-Za-z_][\w.:-]*)[\s>/]", re.sub(r"<!--.*?-->|<\?.*?\?>", "", head, flags=re.S))
    counts = Counter(tags[1:])
    if not counts:
        raise IngestError("no_table", "There are no records in the file.")
    most = max(counts.values())
    row_tag = next(t for t in tags[1:] if counts[t] == most or counts[t] >= 2)
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").load(path)
    out = flatten(df)
    return _numbered(out.toDF(*[c.replace("_VALUE", "value").replace("._", ".").removeprefix("_") for c in out.columns]))


def _from_cells(spark: SparkSession, rows: DataFrame, table_no: int) -> DataFrame:
    part = rows.where(F.col("table_no") == table_no)
    width = part.agg(F.max(F.size("cells"))).first()[0] or 0
    return part.select(*[F.get("cells", i).alias(f"c{i}") for i in range(width)], F.col("row_no").cast("long").alias(ROW_ID))


def _workbook_rows(spark: SparkSession, path: str, limits: Limits) -> DataFrame | None:
    """The rows of a workbook, written once by tasks that read ranges of its sheets; None where only Spark can open path."""
    try:
        plan(path, limits)
    except (OSError, pa.ArrowInvalid):
        return None
    try:
        return written(read_workbook(spark, path, limits), "workbook")
    except PySparkException as e:  # a task's refusal, typed again
        said = re.search(r"IngestError: (.+)", str(e))
        if not said:
            raise
        raise IngestError("unsafe_xml" if "Entity" in said[1] else "corrupt_file", said[1].strip()) from e


def ingest(spark: SparkSession, path: str, limits: Limits = Limits()) -> Ingested:
    """One file as tables: its format is found, its tables are named, typed later (see plans.clean)."""
    meta = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, HEAD_BYTES).alias("head")).first()
    if meta is None or not meta["length"]:
        raise IngestError("empty_file", "The file is empty.")
    if limits.max_bytes is not None and meta["length"] > limits.max_bytes:
        raise IngestError("file_too_large", f"More than {limits.max_bytes >> 20} MB.")
    head = bytes(meta["head"])
    kind = sniff_format(head, path)
    warnings: list[str] = []
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in ("csv", "tsv", "json", "xml", "html", "xlsx", "docx", "xls", "pdf") and ext != kind and (ext, kind) not in (("csv", "tsv"), ("json", "ndjson")):
        warnings.append(f"The file is named .{ext} but holds {kind}.")
    text, encoding = decode(head) if kind in ("csv", "tsv", "json", "ndjson", "xml", "text", "html") else ("", "")
    if encoding and encoding != "utf-8":
        warnings.append(f"The text was read as {encoding}.")
    if kind in ("xls", "pdf"):
        raise IngestError("unsupported_format", f"{kind} files need a reader that is not part of this engine.")
    if kind == "parquet":
        df = spark.read.parquet(path)
        return Ingested(kind, [RawTable("data", _numbered(df), df.count(), df.columns)], warnings=warnings)
    if kind in ("csv", "tsv"):
        delimiter = detect_delimiter(text) or ("\t" if kind == "tsv" else ",")
        raw = read_delimited(spark, path, delimiter, encoding, count_fields(text, delimiter))
        return Ingested("delimited" if kind == "csv" else kind, [_table("data", raw, limits, warnings)], warnings=warnings)
    if kind in ("json", "ndjson"):
        df = read_json(spark, path, kind == "ndjson", warnings)
        names = [c for c in df.columns if c != ROW_ID]
        if all(re.fullmatch(r"c\d+", c) for c in names):
            return Ingested(kind, [_table("data", df, limits, warnings)], warnings=warnings)
        return Ingested(kind, [RawTable("data", df, df.count(), names)], warnings=warnings)
    if kind == "xml":
        df = read_xml(spark, path, text)
        return Ingested(kind, [RawTable("data", df, df.count(), [c for c in df.columns if c != ROW_ID])], warnings=warnings)
    if kind in ("xlsx", "docx", "html"):
        parse = {"xlsx": lambda raw: grids.xlsx_grids(raw, limits), "docx": lambda raw: grids.docx_blocks(raw, limits)[0], "html": lambda raw: grids.html_blocks(raw)[0]}[kind]
        rows = _workbook_rows(spark, path, limits) if kind == "xlsx" else None
        if rows is None:
            rows = grids.document_rows(spark, path, parse, limits).cache()
            error = rows.where("error is not null").select("error").first()
            if error:
                code, _, message = error["error"].partition(": ")
                raise IngestError(code, message)
        named = rows.groupBy("table_no").agg(F.first("table_name").alias("name")).orderBy("table_no").collect()
        tables = [_table(r["name"], _from_cells(spark, rows, r["table_no"]), limits, warnings) for r in named]
        blocks: list[tuple[str, str]] = []
        if kind != "xlsx":
            content = bytes(spark.read.format("binaryFile").load(path).first()["content"])  # one document, within limits
            blocks = grids.docx_blocks(content, limits)[1] if kind == "docx" else grids.html_blocks(content)[1]
        if not tables:
            return _document(spark, kind, blocks, warnings)
        return Ingested(kind, tables, blocks, warnings=warnings)
    spans = detect_fixed_width(text)
    if spans:
        return Ingested("fixed_width", [_table("data", read_fixed_width(spark, path, spans), limits, warnings)], warnings=warnings)
    content = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    found = _document(spark, "text", grids.text_blocks(content), warnings)
    found.key_values = grids.key_values(decode(content)[0].splitlines())
    return found


def _document(spark: SparkSession, kind: str, blocks: list[tuple[str, str]], warnings: list[str]) -> Ingested:
    """A document without tables as one table of its paragraphs."""
    rows, section, n = [], "", 0
    for what, text in blocks:
        if what == "heading":
            section = text
        else:
            n += 1
            rows.append((section, str(n), text, n))
    if not rows:
        raise IngestError("no_table", "There is nothing to analyse in the file.")
    df = spark.createDataFrame(rows, f"section string, paragraph string, text string, {ROW_ID} long")
    return Ingested(kind, [RawTable("Document text", df, len(rows), ["section", "paragraph", "text"])], blocks, warnings=warnings)


def pick_table(tables: list[RawTable]) -> RawTable:
    """The main table: most cells, counting 30 columns at most; document text last."""
    if not tables:
        raise IngestError("no_table", "There is no table in the file.")
    return max(tables, key=lambda t: (t.name != "Document text", t.n_rows * min(len(t.columns), 30)))
