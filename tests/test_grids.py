import datetime
import zipfile

from tallyforge.operators import intake
from tallyforge.sources import grids

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, texts="", styles=(), first=""):
    """A workbook whose first sheet is not the file named first."""
    custom = '<numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="&quot;due &quot;0.00"/><numFmt numFmtId="172" formatCode="[Red]yyyy/mm"/></numFmts>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}>{first}<sheets><sheet name="B" r:id="r7"/><sheet name="A" r:id="r1"/></sheets></workbook>')
        links = '<Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r7" Target="/xl/worksheets/sheet2.xml"/>'
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}>{custom}<cellXfs>{"".join(f"<xf numFmtId={chr(34)}{n}{chr(34)}/>" for n in styles)}</cellXfs></styleSheet>')
        if texts:
            z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{texts}</sst>")


def test_cells_of_a_workbook(spark, tmp_path):
    texts = '<si><t> Date </t></si><si><r><t>two</t></r><r><t xml:space="preserve"> runs</t></r><rPh><t>hint</t></rPh></si>'
    rows = (
        '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
        '<row r="4"><c r="A4" s="1"><v>45779</v></c><c r="B4"><v>10.0</v></c><c r="C4"><v>7881.25</v></c><c r="D4"><v>3</v></c><c r="E4"><v>1E3</v></c></row>'
        '<row><c t="inlineStr"><is><t>in line</t></is></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>A1</f><v> made </v></c><c s="2"><v>0.5</v></c></row>'
        '<row r="6"><c r="A6" s="3"><v>1.5</v></c><c r="B6" s="4"><v>2.5</v></c><c r="C6" s="5"><v>45779.25</v></c><c r="D6"/><c r="AB6"><v>0.126</v></c></row>'
    )
    workbook(tmp_path / "b.xlsx", rows, texts, styles=(0, 14, 20, 170, 171, 172))
    got = [r.cells for r in intake.grid(spark, f"{tmp_path}/b.xlsx").orderBy("row_no").collect()]
    wide = lambda *cells: [*cells] + [""] * (28 - len(cells))
    last = wide("1 day, 12:00:00", "2.50", "02-05-2025")
    last[27] = "0.13"
    assert got == [wide(), wide("Date", "", "two runs"), wide(), wide("02-05-2025", "10", "7881.25", "3", "1000"), wide("in line", "True", "#N/A", "made", "12:00:00"), last]
    workbook(tmp_path / "c.xlsx", '<row><c s="1"><v>366</v></c></row>', styles=(0, 14), first='<workbookPr date1904="1"/>')
    assert [r.cells for r in intake.grid(spark, f"{tmp_path}/c.xlsx").collect()] == [["01-01-1905"]]


def test_quotes_and_line_breaks_of_a_csv_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Bank,"x, ""y"""\r\n\r\n" two\nlines ",1\n,,last\n'.encode())
    got = [(r.row_no, r.cells) for r in intake.grid(spark, f"{tmp_path}/a.csv").orderBy("row_no").collect()]
    assert got == [(0, ["Bank", 'x, "y"', ""]), (1, ["", "", ""]), (2, ["two\nlines", "1", ""]), (3, ["", "", "last"])]


def test_written_statements_read_back_and_folders_of_other_use_do_not(spark, tmp_path):
    day = datetime.date(2025, 3, 1)
    cells = [[("a <b> & \"c\"\nd", None, None), ("", None, None)], [(None, 12.5, None), (None, 7.0, None), (None, None, day)], [("late", None, None)]]
    rows = [(name, k, c) for name in ("x/one.csv", "x/two.xlsx", "golden/three.csv", "four.XLSX", "five.txt.csv") for k, c in enumerate(cells)]
    df = spark.createDataFrame(rows, "file string, row_no long, cells array<struct<text:string,number:double,day:date>>")
    grids.write(df, str(tmp_path / "out"))
    found = grids.read(spark, f"file://{tmp_path}/out").collect()
    by = {}
    for r in sorted(found, key=lambda r: (r.file, r.row_no)):
        by.setdefault(r.file.split("/out/")[1], []).append(r.cells)
    want = [['a <b> & "c"\nd', "", ""], ["12.50", "7", "01-03-2025"], ["late", "", ""]]
    assert by == {name: want for name in ("x/one.csv", "x/two.xlsx", "four.XLSX", "five.txt.csv")}
    assert [p.name for p in (tmp_path / "out" / "golden").iterdir()] == ["three.csv"]  # under its real name
    assert grids.read(spark, f"{tmp_path}/out/golden").count() == 3
    (tmp_path / "empty").mkdir()
    assert grids.read(spark, f"{tmp_path}/empty").collect() == []


def test_a_partition_is_a_few_files(spark, tmp_path, monkeypatch):
    for k in range(130):
        (tmp_path / f"f{k:03}.csv").write_text("a\nb,c\n")
    parts = grids.GridReader(str(tmp_path)).partitions()
    assert [len(p.paths) for p in parts] == [3] * 43 + [1]
    assert grids.dealt([("a", 1), ("b", grids.BYTES), ("c", 1)]) == [["a"], ["b"], ["c"]]
    for held in (1, 2, 5):
        monkeypatch.setattr(grids, "HELD", held)
        assert [row[1:] for row in grids.GridReader(str(tmp_path)).read(grids.Files([f"{tmp_path}/f000.csv"]))] == [(0, ["a", ""]), (1, ["b", "c"])]
    assert grids.read(spark, str(tmp_path)).count() == 260


def test_layouts_are_compared_without_any_file(spark, monkeypatch):
    from tallyforge.plans import statements
    from tallyforge.sources.scratch import Store

    rows = "world_id long, row_no long, txn_id string, value_date date, narration string, ref_no string, credit_paise long, debit_paise long"
    made = [(2, n, f"t{n}", datetime.date(2025, 4, n), "x", "", 100, 0) for n in range(1, 6)]
    monkeypatch.setattr(Store, "folder", lambda self, name: 1 / 0)
    of = statements.Statements(spark.createDataFrame(made, rows), Store(spark))
    assert {(r.role, r.got, r.expected) for r in statements.queries()["statement_role_issues"][0](type("R", (), {"statements": lambda self: of})()).collect()} == {("debit", 4, 3), ("credit", 3, 4)}
