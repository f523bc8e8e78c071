"""The workbook sink and templates, by round trips."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tablewright.plans import typed_export
from tablewright.sources import template, workbook_sink, xlsx


def sheets_of(path):
    with zipfile.ZipFile(path) as z:
        book = z.read("xl/workbook.xml").decode()
        names = [x.split('"')[0] for x in book.split('<sheet name="')[1:]]
        out = {}
        for i, n in enumerate(names, 1):
            only = io.BytesIO()
            with zipfile.ZipFile(only, "w") as y:
                y.writestr("xl/worksheets/sheet1.xml", z.read(f"xl/worksheets/sheet{i}.xml"))
            out[n] = [(r, c, t) for r, c, t in xlsx.read_rows(only.getvalue())]
    return out


def test_sink_round_trip(spark, tmp_path):
    spark.dataSource.register(workbook_sink.WorkbookSource)
    rows = [(f"book{b}", f"part {s}.pdf", s, r, [f"{b}.{s}.{r}", None, "a<&>b", ""]) for b in range(5) for s in range(3) for r in range(4)]
    df = spark.createDataFrame(rows, workbook_sink.SCHEMA).repartition(7)
    named = spark.createDataFrame([(f"book{b}", f"part {s}.pdf", s) for b in range(5) for s in range(4)] + [("bare", "x.pdf", 0)], "workbook string, sheet string, sheet_no int")
    workbook_sink.arranged(df, named).write.format("tablewright_workbooks").mode("append").save(str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["bare.xlsx", *[f"book{b}.xlsx" for b in range(5)]]
    got = sheets_of(tmp_path / "book3.xlsx")
    assert list(got) == ["part 0", "part 1", "part 2", "part 3"]
    assert got["part 1"] == [(r + 1, c, t) for r in range(4) for c, t in ((0, f"3.1.{r}"), (2, "a<&>b"))]
    assert got["part 3"] == sheets_of(tmp_path / "bare.xlsx")["x"] == [(1, 0, "(no data)")]


def test_failed_sink_leaves_no_half_files(spark, tmp_path):
    spark.dataSource.register(workbook_sink.WorkbookSource)
    (tmp_path / "b1.xlsx").write_bytes(b"old")
    rows = spark.createDataFrame([(f"b{i}", "s", 0, r, ["x"]) for i in range(6) for r in range(3)], workbook_sink.SCHEMA)
    bad = workbook_sink.arranged(rows.withColumn("cells", F.when(F.col("workbook") == "b4", F.raise_error(F.lit("lost")).cast("array<string>")).otherwise(F.col("cells"))))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("tablewright_workbooks").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["b1.xlsx"] and (tmp_path / "b1.xlsx").read_bytes() == b"old"
    with pytest.raises(Exception, match="several partitions|aren't together"):
        rows.repartition(3, "row_no").write.format("tablewright_workbooks").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == ["b1.xlsx"]
    with pytest.raises(ValueError, match="mounted"):
        workbook_sink.folder("s3://bucket/x")


def test_header_once(spark):
    rows = spark.createDataFrame([("d", p, r, [f"p{p}", f"r{r}"]) for p in (3, 1, 2) for r in range(3 if p < 3 else 1)], "doc string, page int, row_no int, cells array<string>")
    said = lambda first: [r.cells for r in workbook_sink.stacked_pages(rows, first).orderBy("row_no").collect()]
    assert said(True) == [["Page", "p1", "r0"], ["1", "p1", "r1"], ["1", "p1", "r2"], ["2", "p2", "r1"], ["2", "p2", "r2"]]
    assert said(False)[:2] == [["1", "p1", "r0"], ["1", "p1", "r1"]] and len(said(False)) == 7


@pytest.mark.parametrize(("naming", "wanted", "names"), [
    ("numbered", ["a/b", "A b", "x" * 40, "x" * 40], ["a b", "A b (2)", "x" * 31, "x" * 27 + " (2)"]), ("page", ["p" * 40, "p" * 40, "P" * 40], ["p" * 31, "p" * 28 + "_2", "P" * 31]), ("bank", ["a/b", "a/b", "", "A/b"], ["a-b", "a/b (2)", "Sheet", "A-b"]),
    ("utility", ["  a *  b ", "a b", "", ""], ["a b", "a b 2", "Property", "Property 2"]), ("document", ["q.PDF", "q.docx", "y" * 40, ".pdf"], ["q", "q_2", "y" * 28, "Sheet"]), ("file", ["r.tar.gz", "R.tar", "z" * 40 + ".pdf", "z" * 40], ["r.tar", "R", "z" * 27, "z" * 25 + "_2"]),
])
def test_sheet_names(naming, wanted, names):
    assert xlsx.sheet_names(wanted, naming) == names


def book(rows, cols="", styles=True):
    """A workbook with styles 0 general, 1 date, 2 money, 3 a format of its own; rows are (number, hidden, cells as XML)."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}"{" hidden=\"1\"" if h else ""}>{x}</row>' for r, h, x in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="4"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si><si><t>Date</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}>{cols}<sheetData>{body}</sheetData></worksheet>")
        z.writestr("other.txt", "kept")
    return out.getvalue()


def inline(at, text):
    return f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'


HEAD = '<c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c>' + inline("C3", "Amount") + inline("D3", "Secret") + inline("G3", "Code")
BOOK = book(
    [(1, False, inline("A1", "Title")), (3, False, HEAD), (4, False, inline("A4", "x") + '<c r="B4" s="1"><v>45457</v></c><c r="C4" s="2"><f>1+1</f><v>2.0</v></c>' + inline("D4", "hush") + inline("E4", "loose") + '<c r="G4"><v>7</v></c>'), (5, True, inline("A5", "unseen") + '<c r="B5" s="3"/>')],
    '<cols><col min="4" max="4" hidden="1"/></cols>',
)


def test_template(spark):
    cells = {(r, c): x for r, c, *x in template.template_cells(BOOK)}
    assert cells[4, 1] == ["06/14/2024", "d", "mm/dd/yyyy", False] and cells[4, 2] == ["2", "n", "#,##0.00", False]
    assert cells[4, 3] == ["hush", "s", None, True] and cells[5, 0][3] and cells[5, 1] == ["", "d", "dd/mm/yy", True]
    files = spark.createDataFrame([("t", bytearray(BOOK))], "path string, content binary")
    columns = template.shown(template.read_templates(files)).orderBy("place").collect()
    assert [(r.header_row, r.header, r.col) for r in columns] == [(3, "Name", 0), (3, "Date", 1), (3, "Amount", 2), (3, "", 4), (3, "Code", 6)]
    new = [(0, "Date", "7/4/2025"), (0, "Amount", "$1,234.50"), (0, "Name", " 12 Elm "), (0, "Secret", "no"), (1, "Date", "soon"), (1, "Amount", "12%"), (2, "Name", "00x"), (2, "Code", "9,876"), (0, "Code", "")]
    values = spark.createDataFrame([("t", *v) for v in new], "path string, row_index int, header string, value string")
    out = bytes(template.filled(files, values).first().content)
    after = {(r, c): x for r, c, *x in template.template_cells(out)}
    assert after[4, 1][:3] == ["07/04/2025", "d", "mm/dd/yyyy"] and after[4, 2][:3] == ["1234.5", "n", "#,##0.00"] and after[4, 0][:2] == ["12 Elm", "s"]
    assert after[4, 3] == cells[4, 3] and after[5, 1][:2] == ["soon", "s"] and after[5, 2][:2] == ["12", "n"] and after[6, 0][:2] == ["00x", "s"] and after[6, 6][:2] == ["9876", "n"] and after[4, 6][0] == ""
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert z.read("other.txt") == b"kept" and b"<f>" not in z.read("xl/worksheets/sheet1.xml") and b"ns0:" not in z.read("xl/worksheets/sheet1.xml")


def test_template_without_a_header_row(spark):
    data = book([(2, False, '<c r="B2"><v>1</v></c>'), (3, False, '<c r="B3"><v>2</v></c>' + inline("C3", "t"))], styles=False)
    files = spark.createDataFrame([("t", bytearray(data)), ("none", bytearray(book([])))], "path string, content binary")
    assert [tuple(r) for r in template.shown(template.read_templates(files)).orderBy("place").collect()] == [("t", 2, "1", 0, 1), ("t", 2, "", 1, 2)]


def test_write_by_type(spark, tmp_path):
    rows = spark.createDataFrame([("f1", "purchase", ' 5"x', 0), ("f1", "view", "12 kWh", 1), ("f1", "error", "  ", 2), ("f2", "click", "c", 3)], "file string, field string, value string, seq int")
    out = typed_export.typed_export(rows, typed_export.EXCLUSIVE, typed_export.TEMPLATES, ("view",), "bank_statement")
    assert {(r.file, r.doc_type): [(c.field, c.text) for c in r.columns] for r in out.collect()} == {("f1", "utility_bill"): [("purchase", ' 5"x'), ("view", "12 kWh")], ("f2", "bank_statement"): [("click", "c")]}
    typed_export.write_by_type(out, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/doc_type=utility_bill").first().data in ('{"purchase":" 5\\"x","view":12}', '{"purchase":" 5\\"x","view":12.00}')
