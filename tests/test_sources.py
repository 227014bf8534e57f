"""Files of every format to tables, hostile ones to refusals, and exports back."""

import io
import json
import zipfile

import pytest
from ledgerwright.errors import IngestError
from ledgerwright.sources import grids, sinks, sniff
from ledgerwright.sources.readers import ROW_ID, ingest, pick_table


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return write


def rows(table):
    return [tuple(r) for r in table.df.orderBy(ROW_ID).drop(ROW_ID).collect()]


@pytest.mark.parametrize("d", [",", ";", "\t", "|"])
def test_delimited(spark, put, d):
    text = "\n".join(d.join(x) for x in (["name", "note", "n"], ["a", f'"x{d}y ""q"""', "1"], ["b", '"two\nlines"', "2"]))
    found = ingest(spark, put("f.csv", "﻿" + text))
    assert found.tables[0].columns == ["name", "note", "n"]
    assert rows(found.tables[0]) == [("a", f'x{d}y "q"', "1"), ("b", "two\nlines", "2")]


def test_titles_headers_and_encodings(spark, put):
    text = "Quarterly report\n\nDate,Sales,Sales\n2025-01-01,5,6\n2025-01-02,7,8\n2025-01-03,9,9\n"
    found = ingest(spark, put("t.csv", text))
    assert found.tables[0].columns == ["Date", "Sales", "Sales_2"] and found.tables[0].n_rows == 3 and found.warnings
    assert ingest(spark, put("n.csv", "1,2,3\n4,5,6\n7,8,9\n")).tables[0].columns == ["column_1", "column_2", "column_3"]
    latin = ingest(spark, put("l.csv", "Ort,Wert\nKöln,1\nMünchen,2\n".encode("windows-1252")))
    assert rows(latin.tables[0])[0] == ("Köln", "1") and latin.warnings
    wide = ingest(spark, put("u.csv", "a,b\nx,1\ny,2\n".encode("utf-16-le")))
    assert rows(wide.tables[0]) == [("x", "1"), ("y", "2")]


def test_fixed_width_and_prose(spark, put):
    text = "Name      City      Sales\nAnn       Oslo      12\nBob       Rome      7\nCarla     Lima      100\n"
    found = ingest(spark, put("f.txt", text))
    assert found.format == "fixed_width" and rows(found.tables[0])[2] == ("Carla", "Lima", "100")
    prose = ingest(spark, put("p.txt", "INVOICE\n\nCustomer: Ann Smith of the long road\n\nThis is a paragraph of text that says nothing.\n\nTotal ..... 12\n"))
    assert prose.tables[0].name == "Document text" and ("Customer", "Ann Smith of the long road") in prose.key_values and ("Total", "12") in prose.key_values


def test_json_shapes(spark, put):
    nested = ingest(spark, put("a.json", json.dumps([{"id": 1, "user": {"name": "a", "tags": ["x", "y"]}}, {"id": 2, "user": {"name": "b", "tags": []}}])))
    assert set(nested.tables[0].columns) == {"id", "user.name", "user.tags"}
    assert {r["user.tags"] for r in nested.tables[0].df.collect()} == {"x; y", ""}
    assert ingest(spark, put("e.json", json.dumps({"meta": {"n": 2}, "data": [{"a": 1}, {"a": 2}]}))).tables[0].n_rows == 2
    keyed = ingest(spark, put("k.json", json.dumps({"u1": {"n": 1}, "u2": {"n": 2, "m": 3}})))
    assert keyed.tables[0].columns[0] == "key" and keyed.tables[0].n_rows == 2
    lines = ingest(spark, put("l.ndjson", '{"a":1}\nnot json\n{"a":3}\n'))
    assert lines.tables[0].n_rows == 2 and any("skipped" in w for w in lines.warnings)
    lists = ingest(spark, put("g.json", json.dumps([["name", "n"], ["a", 1], ["b", 2]])))
    assert rows(lists.tables[0]) == [("a", "1"), ("b", "2")]


def test_xml(spark, put):
    found = ingest(spark, put("o.xml", "<orders><order id='1'><item>x</item><qty>2</qty></order><order id='2'><item>y</item><qty>3</qty></order></orders>"))
    assert set(found.tables[0].columns) == {"id", "item", "qty"} and found.tables[0].n_rows == 2
    with pytest.raises(IngestError) as e:
        ingest(spark, put("x.xml", '<!DOCTYPE a [<!ENTITY b "c">]><a><r>&b;</r><r>1</r></a>'))
    assert e.value.code == "unsafe_xml"


def test_html_tables(spark, put):
    page = "<html><body><h2>Costs</h2><table><tr><th>k</th><th>v</th></tr><tr><td rowspan=2>a</td><td>1</td></tr><tr><td>2</td></tr></table><table><caption>Sales</caption><tr><th>p</th><th>q</th></tr><tr><td colspan=2>x</td></tr><tr><td>y</td><td>3</td></tr></table></body></html>"
    found = ingest(spark, put("p.html", page))
    assert [t.name for t in found.tables] == ["Costs", "Sales"]
    assert rows(found.tables[0]) == [("a", "1"), ("a", "2")] and rows(found.tables[1]) == [("x", "x"), ("y", "3")]
    assert pick_table(found.tables).name == "Costs"


def test_workbooks_round_trip(spark, put):
    df = spark.createDataFrame([("a", 1.5, True), ("=cmd", None, False)], "k string, v double, ok boolean")
    found = ingest(spark, put("w.xlsx", sinks.to_xlsx(df, "Mine")))
    assert found.tables[0].name == "Mine" and rows(found.tables[0]) == [("a", "1.5", "true"), ("=cmd", None, "false")]


def test_documents(spark, put):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f"<w:document xmlns:w='{w}'><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>Plan</w:t></w:r></w:p><w:tbl><w:tr>{cell('k')}{cell('v')}</w:tr><w:tr>{cell('a')}{cell('1')}</w:tr><w:tr>{cell('b')}{cell('2')}</w:tr></w:tbl></w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    found = ingest(spark, put("d.docx", out.getvalue()))
    assert found.tables[0].name == "Plan" and rows(found.tables[0]) == [("a", "1"), ("b", "2")] and found.blocks[0] == ("heading", "Plan")


def test_hostile_files(spark, put):
    def archive(name, content):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, content)
        return out.getvalue()

    cases = {"empty.csv": (b"", "empty_file"), "bin.csv": (bytes(range(1, 9)) * 100, "binary_file"), "old.xls": (b"\xd0\xcf\x11\xe0" + b"x" * 50, "unsupported_format"), "a.pdf": (b"%PDF-1.4 x", "unsupported_format"), "bomb.xlsx": (archive("xl/workbook.xml", b"\0" * (40 << 20)), "unsafe_archive"), "up.xlsx": (archive("../xl/x", b"1"), "unsafe_archive")}
    for name, (content, code) in cases.items():
        with pytest.raises(IngestError) as e:
            ingest(spark, put(name, content))
        assert e.value.code == code, name


def test_positioned_text():
    items = [(10, 100, "k"), (80, 101, "v"), (10, 80, "a"), (80, 80, "1"), (10, 60, "b"), (81, 60, "2"), (10, 20, "end")]
    assert grids.find_tables(grids.group_lines(items)) == [("Table 1", [["k", "v"], ["a", "1"], ["b", "2"]])]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", "-5", 1.0), ("+x", "@y", None), ("plain", None, 2.0)], "a string, b string, v double")
    sinks.write_csv(df, str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*")))
    assert "'=1+1" in text and ",-5," in text and "'+x" in text and "'@y" in text and "\r\n" in text
    got = sinks.json_result(df, 2)
    assert got["truncated"] and len(got["rows"]) == 2
    sinks.write_parquet(df, str(tmp_path / "p"), "a")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def test_names():
    assert sniff.column_names(["a", " a ", "", None, "b  c"], 5) == ["a", "a_2", "column_3", "column_4", "b c"]
    assert sniff.detect_delimiter("a;b\n1,5;2\n2,5;3\n") == ";" and sniff.detect_delimiter("no table here\njust words\n") is None
    assert sniff.sniff_format(b'{"a":1}\n{"a":2}\n') == "ndjson" and sniff.sniff_format(b"<html><p>x") == "html"
