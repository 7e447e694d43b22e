"""Workbooks written as a whole or not at all: styles, links, each check of the gate, and a failed gate."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from kinlink.operators import report
from kinlink.sources import output, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
STYLES = f"""<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="12"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFFFEB9C"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellXfs count="3"><xf numFmtId="0" fontId="0" fillId="0" borderId="0"/><xf numFmtId="0" fontId="1" fillId="0" borderId="0" applyFont="1"/><xf numFmtId="0" fontId="1" fillId="2" borderId="0" applyFill="1"/></cellXfs></styleSheet>"""
SHEET = f"""<worksheet xmlns="{MAIN}" xmlns:r="{REL}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="x14ac">
<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews><cols><col min="1" max="2" width="20" customWidth="1"/></cols>
<sheetData><row r="1"><c r="A1" s="1" t="s"><v>0</v></c><c r="B1" s="1" t="s"><v>1</v></c><c r="C1" s="1" t="inlineStr"><is><t>remarks</t></is></c><c r="D1" t="inlineStr"><is><t>twitch_id_link</t></is></c></row>
<row r="2"><c r="A2" t="inlineStr"><is><t>alpha</t></is></c><c r="B2" s="2" t="inlineStr"><is><t>old</t></is></c><c r="D2" t="inlineStr"><is><t>https://was.example</t></is></c><c r="E2"><f>1+1</f><v>2</v></c></row>
<row r="3"><c r="A3" t="inlineStr"><is><t>beta</t></is></c><c r="B3" s="2"/><c r="F3" t="inlineStr"><is><t>wide</t></is></c></row></sheetData>
<autoFilter ref="A1:C3"/><mergeCells count="1"><mergeCell ref="F3:G4"/></mergeCells><conditionalFormatting sqref="A1"><cfRule type="expression" priority="1"><formula>TRUE</formula></cfRule></conditionalFormatting>
<dataValidations count="1"><dataValidation type="list" sqref="C2"/></dataValidations><hyperlinks><hyperlink ref="D2" r:id="rId1"/></hyperlinks><pageMargins left="1" right="1" top="1" bottom="1" header="1" footer="1"/></worksheet>"""
OTHER = f'<worksheet xmlns="{MAIN}"><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>'


def book(path, **parts):
    rel = "http://schemas.openxmlformats.org/package/2006/relationships"
    every = {
        "[Content_Types].xml": "<Types/>",
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}"><si><t>id_kick</t></si><si><t>id_twitch</t></si></sst>', "xl/styles.xml": STYLES, "xl/worksheets/sheet1.xml": SHEET, "xl/worksheets/sheet2.xml": OTHER,
        "xl/worksheets/_rels/sheet1.xml.rels": f'<Relationships xmlns="{rel}"><Relationship Id="rId1" Type="{REL}/hyperlink" Target="https://was.example" TargetMode="External"/></Relationships>', "xl/vbaProject.bin": "macro",
    } | parts
    with zipfile.ZipFile(path, "w") as z:
        for name, body in every.items():
            z.writestr(name, body)
    return path


def change(row, col, value, kind="write", like=None, sheet="One"):
    return {"sheet": sheet, "row": row, "col": col, "value": value, "kind": kind, "like": like}


CHANGES = [
    change(2, 3, "no twitch id found"), change(3, 2, "beta_tv"), change(2, 2, None, "fill"), change(2, 4, "https://twitch.example/a\nhttps://b.example", "link"), change(3, 4, "none here", "link"),
    change(1, 8, "kick_id_link", "link_header", 1), change(3, 8, "https://kick.example/beta x", "link"), change(2, 1, "alpha", "check"), change(3, 1, "beta", "check"),
]


def test_styles_are_read(spark, tmp_path):
    workbook.register(spark)
    cells = spark.read.format("workbook").option("styles", "true").load(book(str(tmp_path / "a.xlsx")))
    assert [tuple(r) for r in report.stale_highlights(cells, 2, 1).collect()] == [("One", 2, 2)]
    found = {(r.sheet, r.row, r.col): r for r in cells.collect()}
    assert found["One", 2, 4].link == "https://was.example" and found["One", 3, 2].fill == "FFFFEB9C" and found["One", 1, 1].value == "id_kick" and found["One", 1, 1].fill_type == "none"
    assert spark.read.format("workbook").load(str(tmp_path / "a.xlsx")).columns == ["sheet", "row", "col", "value"]


def test_written_and_compared(spark, tmp_path):
    originals = [book(str(tmp_path / f"{n}.xlsx")) for n in "ab"]
    rows = [(o, o.replace(".xlsx", "-out.xlsx"), *(c[k] for k in ("sheet", "row", "col", "value", "kind", "like"))) for o in originals for c in CHANGES]
    output.released(spark.createDataFrame(rows, output.CHANGES).repartition(5))
    for o in originals:
        out = o.replace(".xlsx", "-out.xlsx")
        assert all(ok for _, ok, _ in output.compared(o, out, CHANGES))
        cells = {(r[1], r[2]): r for r in workbook.read_styled_cells(out) if r[0] == "One"}
        assert cells[3, 2][3] == "beta_tv" and cells[2, 2][3:5] == ("old", "none") and cells[2, 5][3] == "=1+1"
        assert cells[2, 4][6] == "https://twitch.example/a" and cells[3, 8][6] == "https://kick.example/beta" and cells[3, 4][6] is None
        with output.Book(out) as b, output.Book(o) as was:
            sheet = b.sheet("One")
            links = sheet.cells(b.shared)
            assert b.styles.signature(links[1, 8].style) == was.styles.signature(1) and sheet.shape()["column_widths"][8] == "48"
            assert b"0563C1" in b.styles.signature(links[2, 4].style)[1] and b.zip.read("xl/vbaProject.bin") == b"macro"
            order = [x.tag.split("}")[1] for x in sheet.root]
            assert order.index("dataValidations") < order.index("hyperlinks") < order.index("pageMargins")
    assert sorted(os.listdir(tmp_path)) == ["a-out.xlsx", "a.xlsx", "b-out.xlsx", "b.xlsx"]


@pytest.mark.parametrize("bad", [change(3, 1, "gamma", "check"), change(2, 6, "=1"), change(4, 7, "merged"), change(2, 3, "x", sheet="None"), change(2, 3, "twice")])
def test_a_failed_gate_leaves_nothing(spark, tmp_path, bad):
    originals = [book(str(tmp_path / f"{n}.xlsx")) for n in "abcd"]
    rows = [(o, o.replace(".xlsx", "-out.xlsx"), *(c[k] for k in ("sheet", "row", "col", "value", "kind", "like"))) for k, o in enumerate(originals) for c in [*CHANGES[:2], *([bad] if k == 2 else [])]]
    with pytest.raises(Exception, match="verification failed|like a formula|merged range|missing sheet|two changes"):
        output.released(spark.createDataFrame(rows, output.CHANGES))
    assert sorted(os.listdir(tmp_path)) == ["a.xlsx", "b.xlsx", "c.xlsx", "d.xlsx"]


def test_an_output_in_several_partitions_is_not_released(spark, tmp_path):
    o = book(str(tmp_path / "a.xlsx"))
    rows = [(o, str(tmp_path / "out.xlsx"), *(c[k] for k in ("sheet", "row", "col", "value", "kind", "like"))) for c in CHANGES[:2]]
    output.register(spark)
    with pytest.raises(Exception, match="several partitions"):
        spark.createDataFrame(rows, output.CHANGES).repartition(2, F.col("row")).repartitionByRange(2, "row").write.format("workbook_output").mode("append").save()
    assert os.listdir(tmp_path) == ["a.xlsx"]


TAMPERED = {
    "sheet_names_and_order": {"xl/workbook.xml": lambda x: x.replace("Two", "2")},
    "dimensions[Two]": {"xl/worksheets/sheet2.xml": lambda x: x.replace("</sheetData>", '<row r="9"><c r="C9"><v>1</v></c></row></sheetData>')},
    "merged_cells[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace("F3:G4", "F3:G5")},
    "freeze_panes[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace('topLeftCell="A2"', 'topLeftCell="A3"')},
    "auto_filter[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace("A1:C3", "A1:C2")},
    "column_widths[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace('width="20"', 'width="21"')},
    "conditional_formatting[One]": {"xl/worksheets/sheet1.xml": lambda x: x[: x.index("<conditionalFormatting")] + x[x.index("<dataValidations") :]},
    "data_validations[One]": {"xl/worksheets/sheet1.xml": lambda x: x[: x.index("<dataValidations")] + x[x.index("<hyperlinks") :]},
    "cell_values[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace("wide", "wild")},
    "cell_formatting[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace('r="A1" s="1"', 'r="A1" s="0"')},
    "hyperlinks[One]": {"xl/worksheets/_rels/sheet1.xml.rels": lambda x: x.replace("was.example", "is.example")},
    "row_identity[One]": {"xl/worksheets/sheet1.xml": lambda x: x.replace("alpha", "alpho")},
    "other_parts": {"xl/vbaProject.bin": lambda x: x + "!"},
}


@pytest.mark.parametrize("check", sorted(TAMPERED))
def test_each_check(tmp_path, check):
    o, out = book(str(tmp_path / "a.xlsx")), str(tmp_path / "b.xlsx")
    demands = [change(2, 1, "alpha", "check")]
    output.write_changed(o, out, demands)
    assert all(ok for _, ok, _ in output.compared(o, out, demands))
    with zipfile.ZipFile(o) as z:
        parts = {n: f(z.read(n).decode()) for n, f in TAMPERED[check].items()}
    book(out, **parts)
    failed = {c for c, ok, _ in output.compared(o, out, demands) if not ok}
    assert check in failed and failed <= {check, "other_parts", *({"cell_values[One]", "cell_values[Two]"} if check[:3] in ("row", "dim") else ())}


def test_broken_files(tmp_path):
    o, out = book(str(tmp_path / "a.xlsx")), tmp_path / "b.xlsx"
    out.write_bytes(b"PK nothing")
    assert [(c, ok) for c, ok, _ in output.compared(o, str(out), [])] == [("workbook_opens", False)]
