"""Workbooks written part by part, held against CSV exports of the same sheets."""

from __future__ import annotations

import csv
import zipfile
from xml.sax.saxutils import escape

import pytest

from zoneloom.operators import shape
from zoneloom.plans import inputs
from zoneloom.sources.tables import read_text_table
from zoneloom.sources.workbook import is_date, scan_sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="[$-409]yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="4"/></cellXfs></styleSheet>'


def letters(column):
    name = ""
    while column >= 0:
        name, column = chr(65 + column % 26) + name, column // 26 - 1
    return name


def write(path, sheets, strings=(), settings=""):
    """``sheets``: XML of the rows by name; ``strings``: XML of the shared items."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("_rels/.rels", f'<Relationships xmlns="x"><Relationship Id="a" Type="{KINDS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="s{i}"/>' for i, n in enumerate(sheets))
        out.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{KINDS}">{settings}<sheets>{listed}</sheets></workbook>')
        targets = [(f"s{i}", "worksheet", f"/xl/worksheets/sheet{i + 1}.xml" if i else "worksheets/sheet1.xml") for i in range(len(sheets))]
        targets += [("t", "styles", "styles.xml")] + ([("q", "sharedStrings", "sharedStrings.xml")] if strings else [])
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(
            f'<Relationship Id="{i}" Type="{KINDS}/{kind}" Target="{target}"/>' for i, kind, target in targets) + "</Relationships>")
        out.writestr("xl/styles.xml", STYLES)
        if strings:
            out.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i, rows in enumerate(sheets.values()):
            out.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {MAIN}><dimension ref='A1'/><sheetData>{rows}</sheetData><mergeCells/></worksheet>")


def sheet_of(table, strings):
    """Rows of text and numbers as XML, texts by their number among ``strings``, which grows."""
    index, rows = {s: i for i, s in enumerate(strings)}, []
    for r, values in enumerate(table, 1):
        cells = []
        for c, value in enumerate(values):
            if isinstance(value, str):
                if value not in index:
                    index[value] = len(strings)
                    strings.append(value)
                cells.append(f'<c r="{letters(c)}{r}" t="s"><v>{index[value]}</v></c>')
            elif value is not None:
                cells.append(f'<c r="{letters(c)}{r}"><v>{value!r}</v></c>')
        rows.append(f'<row r="{r}">{"".join(cells)}</row>')
    return "".join(rows)


def as_xml(strings):
    return [f'<t xml:space="preserve">{escape(s)}</t>' for s in strings]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_workbook_equals_its_export(spark, tmp_path):
    """Wide and long sheets, in a folder of two files, through the cleaning that follows."""
    head = ["State Name [Public School] Latest available year", "Latitude [Public School] 2019-20", *[f"X{letters(i)} Students" for i in range(40)]]
    folder = tmp_path / "books"
    folder.mkdir()
    for name, n in (("a", 23_000), ("b", 7)):
        table = [head, *[[("New York", "Café & <b>", "†", " x ")[i % 4], 40 + i / 7 if i % 7 else 40 + i // 7, *[[i * j, None, "–"][(i + j) % 3] for j in range(40)]] for i in range(n)]]
        strings: list[str] = []
        rows = sheet_of(table, strings)
        write(folder / f"{name}.xlsx", {"Data": rows}, as_xml(strings))
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8") as out:
            csv.writer(out).writerows(table)
        if name == "a":
            single = read_text_table(spark, str(folder / "a.xlsx"))
            export = spark.read.option("ignoreLeadingWhiteSpace", False).csv(str(tmp_path / "a.csv"), header=True)
            assert single.columns == export.columns
            assert single.exceptAll(export).isEmpty() and export.exceptAll(single).isEmpty()
            assert shape.clean_headers(single, inputs.HEADER_NOISE).columns[:2] == ["StateName", "Latitude"]
    (folder / "~$a.xlsx").write_bytes(b"lock")
    both = scan_sheets(spark, str(folder), columns=[head[1], head[0]])
    assert both.columns == [head[1], head[0]] and both.count() == 23_007 and both.rdd.getNumPartitions() == 2


def test_cells_of_every_kind(spark, tmp_path):
    path = tmp_path / "kinds.xlsx"
    strings = ["<t>name</t>", "<r><t>ri</t></r><r><rPr><b/></rPr><t xml:space='preserve'>ch </t></r><rPh sb='0' eb='1'><t>reading</t></rPh>", "<t>a_x000D_b_x005F_x0041_</t>", "<t/>"]
    rows = """
      <row r="1"><c r="A1" t="inlineStr"><is><t>A heading</t></is></c></row>
      <row r="4"><c r="B4" t="s"><v>0</v></c><c r="C4" t="inlineStr"><is><r><t>val</t></r><r><t>ue</t></r></is></c><c r="E4" t="str"><v>made</v></c></row>
      <row r="5"><c r="A5"><v>9</v></c><c r="B5" t="s"><v>1</v></c><c r="C5"><v>170993000001</v></c><c r="D5"><v>7</v></c><c r="E5" t="b"><v>1</v></c></row>
      <row r="6"/>
      <row><c/><c t="s"><v>2</v></c><c s="1"><v>43831</v></c><c/><c t="e"><v>#N/A</v></c></row>
      <row><c r="C8" s="2"><v>43831.75</v></c><c r="E8" s="1"><v>0.5</v></c></row>
      <row r="9"><c r="B9" t="s"><v>3</v></c><c r="C9" s="3"><v>0.10000000000000001</v></c><c r="E9" t="str"><f>A1</f><v>text</v></c></row>
      <row r="10"><c r="D10"><v>5</v></c></row>"""
    write(path, {"First": "", "Second": rows}, strings)
    got = scan_sheets(spark, str(path), sheet="Second", skip=3)
    assert got.columns == ["name", "value", "made"]
    assert rows_of(got) == sorted([
        ("rich ", "170993000001", "TRUE"), ("a\rb_x0041_", "2020-01-01", None), (None, "2020-01-01 18:00:00", "12:00:00"), (None, "0.1", "text"),
    ], key=str)
    write(path, {"First": sheet_of([["day"]], names := []) + '<row r="2"><c r="A2" s="1"><v>0</v></c></row>'}, as_xml(names), '<workbookPr date1904="1"/>')
    assert rows_of(scan_sheets(spark, str(path))) == [("1904-01-01",)]


def test_workbooks_that_do_not_fit(spark, tmp_path):
    write(tmp_path / "a.xlsx", {"One": sheet_of([["k", "k"], [1, 2]], strings := [])}, as_xml(strings))
    with pytest.raises(Exception, match="repeated column names"):
        scan_sheets(spark, str(tmp_path / "a.xlsx")).collect()
    with pytest.raises(Exception, match="no sheet 'Two' among One"):
        scan_sheets(spark, str(tmp_path), ["k"], sheet="Two").collect()
    write(tmp_path / "a.xlsx", {"One": sheet_of([["k"], [1], [2]], strings := [])}, as_xml(strings))
    assert rows_of(scan_sheets(spark, str(tmp_path), ["k"])) == [("1",), ("2",)]
    with pytest.raises(Exception, match="no column z"):
        scan_sheets(spark, str(tmp_path), ["z"]).collect()
    with pytest.raises(Exception, match="no .*xlsx below"):
        scan_sheets(spark, str(tmp_path), ["z"], pattern="*none.xlsx").collect()
    write(tmp_path / "empty.xlsx", {"One": ""})
    assert scan_sheets(spark, str(tmp_path / "empty.xlsx")).columns == []


def test_formats_that_show_dates():
    assert all(map(is_date, ["yyyy-mm-dd", "[h]:mm", 'd"."m', "[$-409]mmm d;@"]))
    assert not any(map(is_date, ["General", "0.00E+00", '0" days"', "[Red]#,##0", "@", r"0\d", "#,##0;[Red]dd"]))
