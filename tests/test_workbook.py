"""Workbooks in parts: ranges against whole sheets, pieces against plain archives."""

import io
import os
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from ledgerwright.errors import IngestError
from ledgerwright.sources import workbook as wb
from ledgerwright.sources.grids import xlsx_grids
from ledgerwright.sources.readers import ROW_ID, ingest
from ledgerwright.sources.sniff import Limits
from pyspark.sql import functions as F

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def book(sheets, strings=(), prefix="", tail=""):
    """An archive of sheets (name, row XML), in the default or a named namespace."""
    p, ns = (f"{prefix}:", f'xmlns:{prefix}="{MAIN}"') if prefix else ("", f'xmlns="{MAIN}"')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}"><sheets>{"".join(f"<sheet name={chr(34)}{n}{chr(34)}/>" for n, _ in sheets)}</sheets></workbook>')
        z.writestr("xl/styles.xml", '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, (_, body) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0"?><{p}worksheet {ns}><{p}rowBreaks/><{p}sheetData>{body}</{p}sheetData>{tail}</{p}worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{"".join(f"<si><t>{s}</t></si>" if i % 2 else f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for i, s in enumerate(strings))}</sst>')
    return out.getvalue()


def cells(df):
    return [(r["table_no"], r["table_name"], r["row_no"], r["cells"]) for r in df.orderBy("table_no", "row_no").collect()]


def whole(raw):
    return [(t, name, i, row) for t, (name, grid) in enumerate(xlsx_grids(raw)) for i, row in enumerate(grid)]


@pytest.mark.parametrize("prefix", ["", "x"])
@pytest.mark.parametrize("size", [64, 700, 1 << 20])
def test_ranges_read_what_the_whole_has(spark, tmp_path, prefix, size):
    p = f"{prefix}:" if prefix else ""

    def row(i):
        kind = [f'<{p}c t="s"><{p}v>{i % 5}</{p}v></{p}c>', f'<{p}c r="C{i + 1}" s="1"><{p}v>{45000 + i}</{p}v></{p}c>', f'<{p}c t="inlineStr"><{p}is><{p}t>a &lt;row&gt; {"é" * (i % 40)}</{p}t></{p}is></{p}c>', f'<{p}c t="b"><{p}v>1</{p}v></{p}c>', f'<{p}c t="s"><{p}v>99</{p}v></{p}c>']
        return f'<{p}row r="{i + 1}">{"".join(kind[k] for k in range(5) if (i + k) % 3)}</{p}row>' if i % 11 else f"<{p}row/>"

    raw = book([("One", "".join(map(row, range(120)))), ("Two", "".join(map(row, range(7)))), ("Empty", "")], ["zero", "one", "two", "three", "four"], prefix, f"<{p}mergeCells>{'x' * 3000}</{p}mergeCells>")
    path = tmp_path / "b.xlsx"
    path.write_bytes(raw)
    df = wb.read_workbook(spark, str(path), range_bytes=size)
    assert cells(df) == whole(raw)
    assert df.rdd.getNumPartitions() == len(wb.plan(str(path), range_bytes=size)[1])


def test_a_large_sheet_is_read_by_many_tasks(spark, tmp_path):
    df = spark.range(200_000).repartitionByRange(6, "id").sortWithinPartitions("id").select("id", F.concat(F.lit("text & "), F.col("id") % 97).alias("label"), (F.col("id") / 4).alias("v"), (F.col("id") % 2 == 0).alias("ok"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"))
    path = str(tmp_path / "large.xlsx")
    wb.write_workbook(df, path, "Sales")
    assert os.listdir(tmp_path) == ["large.xlsx"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and len(z.namelist()) == 5
    rows = wb.read_workbook(spark, path, range_bytes=4 << 20)
    assert rows.rdd.getNumPartitions() > 5
    table = rows.where("row_no > 0").select("row_no", F.get("cells", F.lit(0)).cast("long").alias("id"), F.get("cells", F.lit(1)).alias("label"), F.get("cells", F.lit(2)).cast("double").alias("v"), F.get("cells", F.lit(3)).alias("ok"), F.get("cells", F.lit(4)).alias("day"))
    assert table.where("row_no = id + 1 and label = concat('text & ', id % 97) and v = id / 4 and ok = (id % 2 = 0) and day = cast(date_add(date'2024-01-01', int(id % 50)) as string)").count() == 200_000
    found = ingest(spark, path)
    assert found.tables[0].name == "Sales" and found.tables[0].n_rows == 200_000 and found.tables[0].columns == ["id", "label", "v", "ok", "day"]
    assert found.tables[0].df.orderBy(ROW_ID).first()["label"] == "text & 0"


def test_rows_beyond_a_sheet_go_to_the_next(tmp_path, monkeypatch):
    monkeypatch.setattr(wb, "SHEET_ROWS", 8)
    path = str(tmp_path / "w.xlsx")
    writer = wb._Writer(path, "Data", ["k"], True)
    os.makedirs(writer.folder)
    messages = []
    for task in (1, 0, 2):  # out of order
        pieces = []
        for n in range(2):
            text = "".join(wb._row([f"{task}.{n}.{i}"]) for i in range(3)).encode()
            (tmp_path / f"{os.path.basename(writer.folder)}/{task}-{n}").write_bytes(wb._deflated(text))
            pieces.append(wb.Piece(f"{task}-{n}", 3, len(text), zlib.crc32(text)))
        messages.append(wb._Done(task, pieces))
    writer.commit([*messages, None])
    assert os.listdir(tmp_path) == ["w.xlsx"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
    grids = xlsx_grids((tmp_path / "w.xlsx").read_bytes())
    assert [n for n, _ in grids] == ["Data", "Data 2", "Data 3"] and all(g[0] == ["k"] for _, g in grids)
    assert [r[0] for _, g in grids for r in g[1:]] == [f"{t}.{n}.{i}" for t in range(3) for n in range(2) for i in range(3)]
    with pytest.raises(FileExistsError):
        wb._Writer(path, "Data", ["k"], False).commit([])


def test_odd_values_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "odd.xlsx")
    df = spark.createDataFrame([(None, float("nan"), "<&\x01\n", None), (1, float("inf"), "", True)], "`a.b` int, `x``y` double, t string, ok boolean").coalesce(1)
    wb.write_workbook(df, path)
    assert cells(wb.read_workbook(spark, path)) == [(0, "Data", 0, ["a.b", "x`y", "t", "ok"]), (0, "Data", 1, [None, None, "<&\n", None]), (0, "Data", 2, ["1", None, "", "true"])]
    wb.write_workbook(df.limit(0), path)
    assert cells(wb.read_workbook(spark, path)) == [(0, "Data", 0, ["a.b", "x`y", "t", "ok"])]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("v"))
    with pytest.raises(Exception, match="no"):
        wb.write_workbook(df, str(tmp_path / "broken.xlsx"))
    assert os.listdir(tmp_path) == []


def test_hostile_workbooks(spark, tmp_path):
    bomb = book([("S", "<row/>" * 3_000_000)])
    (tmp_path / "bomb.xlsx").write_bytes(bomb)
    with pytest.raises(IngestError) as e:
        ingest(spark, str(tmp_path / "bomb.xlsx"), Limits(max_ratio=5))
    assert e.value.code == "unsafe_archive"
    raw = book([("S", "<row><c><v>1</v></c></row>")]).replace(b"", b"")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(raw)) as a, zipfile.ZipFile(out, "w") as b:
        for name in a.namelist():
            content = a.read(name)
            b.writestr(name, content.replace(b"<worksheet", b'<!DOCTYPE a [<!ENTITY b "c">]><worksheet') if "sheet1" in name else content)
    (tmp_path / "entity.xlsx").write_bytes(out.getvalue())
    with pytest.raises(IngestError) as e:
        ingest(spark, str(tmp_path / "entity.xlsx"))
    assert e.value.code == "unsafe_xml"


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_checksums_of_parts(a, b):
    assert wb.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
