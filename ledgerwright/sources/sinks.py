"""Exports: CSV that no spreadsheet runs, workbooks, JSON and Parquet."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would run (= + - @ and control characters) behind an apostrophe; numbers as they are."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(_NUMBER), F.concat(F.lit("'"), c)).otherwise(c)


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; all text cells are guarded. single: one file, for results of a bounded size."""
    columns = [guarded(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    out = df.select(*columns)
    (out.coalesce(1) if single else out).write.csv(path, header=True, quote='"', escape='"', lineSep="\r\n", mode="overwrite")


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_result(df: DataFrame, cap: int = 10_000) -> dict:
    """columns, rows and whether rows were left out, of at most cap rows."""
    rows = df.limit(cap + 1).collect()
    return {"columns": df.columns, "rows": [list(r) for r in rows[:cap]], "truncated": len(rows) > cap}


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, k = divmod(i - 1, 26)
        out = chr(65 + k) + out
    return out


def to_xlsx(df: DataFrame, sheet: str = "Data", cap: int = 100_000) -> bytes:
    """A workbook of values only, of at most cap rows (it is built on the driver)."""

    def cell(value: object, r: int, c: int) -> str:
        at = f"{_letters(c)}{r}"
        if value is None:
            return ""
        if isinstance(value, bool):
            return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
        if isinstance(value, (int, float)):
            return f'<c r="{at}"><v>{value}</v></c>' if value == value and abs(value) != float("inf") else ""
        text = "".join(ch for ch in str(value) if ch >= " " or ch in "\t\n\r")
        return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    rows = [df.columns, *(list(r) for r in df.limit(cap).collect())]
    body = "".join(f'<row r="{i + 1}">{"".join(cell(v, i + 1, k) for k, v in enumerate(row))}</row>' for i, row in enumerate(rows))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package, head = "http://schemas.openxmlformats.org/package/2006", '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    spreadsheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{spreadsheet}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{spreadsheet}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(sheet[:31])}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, content in parts.items():
            archive.writestr(name, head + content)
    return out.getvalue()
