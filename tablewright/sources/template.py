"""A customer's workbook as a template: what it shows, and values written back in the kind of cell they replace."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .xlsx import column_name, column_number

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_NS = f"{{{_MAIN}}}"
#: Number formats that have no entry of their own in a workbook's styles.
BUILT_IN = {1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 14: "mm/dd/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0"}
EPOCH = datetime(1899, 12, 30)
CELLS = "row int, col int, text string, kind string, format string, hidden boolean"


def is_date_format(format_: str | None) -> bool:
    return bool(format_ and re.search(r"[ymdhs]", format_.lower()))


def formats_of(z: zipfile.ZipFile) -> list[str | None]:
    """Number format of each cell style."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(x.get("numFmtId")): x.get("formatCode") for x in root.iter(f"{_NS}numFmt")}
    styles = root.find(f"{_NS}cellXfs")
    return [own.get(i, BUILT_IN.get(i)) for i in (int(x.get("numFmtId") or 0) for x in (styles if styles is not None else ()))]


def first_sheet(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    return "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else next(n for n in sorted(names) if n.startswith("xl/worksheets/"))


def template_cells(data: bytes) -> Iterator[tuple[int, int, str, str, str | None, bool]]:
    """CELLS of a workbook's first sheet, rows from 1, columns from 0: text as it is shown (dates as MM/DD/YYYY), the kind s, n or d, the number format, and
    whether its row or column is hidden."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        formats, shared = formats_of(z), []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        root = ElementTree.fromstring(z.read(first_sheet(z)))
    hidden = {c for x in root.iter(f"{_NS}col") if x.get("hidden") in ("1", "true") for c in range(int(x.get("min")) - 1, min(int(x.get("max")), 16384))}
    for row in root.iter(f"{_NS}row"):
        unseen = row.get("hidden") in ("1", "true")
        for cell in row.iter(f"{_NS}c"):
            value, kind, at = cell.find(f"{_NS}v"), cell.get("t"), cell.get("r")
            style = int(cell.get("s") or 0)
            format_ = formats[style] if style < len(formats) else None
            col = column_number(at)
            if kind == "inlineStr":
                text, kind = "".join(t.text or "" for t in cell.iter(f"{_NS}t")), "s"
            elif value is None or value.text is None:
                text, kind = "", "d" if is_date_format(format_) else "n" if format_ else "s"
            elif kind == "s":
                text, kind = shared[int(value.text)], "s"
            elif kind in ("str", "e", "b"):
                text, kind = value.text, "s"
            elif kind == "d" or is_date_format(format_):
                text, kind = (datetime.fromisoformat(value.text[:10]) if kind == "d" else EPOCH + timedelta(days=float(value.text))).strftime("%m/%d/%Y"), "d"
            else:
                text, kind = re.sub(r"^(-?\d+)\.0+$", r"\1", value.text), "n"
            yield int(re.search(r"\d+", at)[0]), col, text, kind, format_, unseen or col in hidden


def read_templates(files: DataFrame) -> DataFrame:
    """(path, row, col, text, kind, format, hidden) of workbooks that spark.read.format("binaryFile") found."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                cells = list(zip(*template_cells(content.as_py()), strict=True)) or [[]] * 6
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(cells[0]), pa.string()), *[pa.array(c, t) for c, t in zip(cells, kinds, strict=True)]], ["path", *[x.split(" ")[0] for x in CELLS.split(", ")]])

    return files.select("path", "content").mapInArrow(read, f"path string, {CELLS}")


def shown(cells: DataFrame, within: int = 15) -> DataFrame:
    """(path, header_row, header, place, col) of the columns that a template shows, in order: of its first rows with anything in them the one with most cells
    of text is the header (two at least, the earliest of equals), else the first of them; hidden columns are left out, and those without a header and without
    a value below it."""
    filled = cells.filter(F.trim("text") != "")
    rows = filled.groupBy("path", "row").agg(F.count_if(F.col("kind") == "s").alias("n"))
    ranked = rows.groupBy("path").agg(F.slice(F.array_sort(F.collect_list(F.struct("row", "n"))), 1, within).alias("rs"))
    best = F.array_min(F.transform(F.filter("rs", lambda r: r["n"] >= 2), lambda r: F.struct((-r["n"]).alias("n"), r["row"].alias("row"))))["row"]
    heads = ranked.select("path", F.coalesce(best, F.get("rs", F.lit(0))["row"]).alias("header_row"))
    of = filled.join(heads, "path")
    columns = of.groupBy("path", "header_row", "col").agg(F.max(F.when(F.col("row") == F.col("header_row"), F.trim("text"))).alias("header"), F.bool_or(F.col("row") > F.col("header_row")).alias("below"))
    # a hidden row hides none of its columns
    hidden = cells.groupBy("path", "col").agg(F.bool_and("hidden").alias("hidden"))
    kept = columns.join(hidden, ["path", "col"]).filter(~F.col("hidden") & (F.col("header").isNotNull() | F.col("below")))
    lists = kept.groupBy("path", "header_row").agg(F.array_sort(F.collect_list(F.struct("col", F.coalesce("header", F.lit("")).alias("header")))).alias("cs"))
    return lists.select("path", "header_row", F.posexplode("cs").alias("place", "c")).select("path", "header_row", "c.header", "place", "c.col")


def coerced(raw: Column, kind: Column, format_: Column) -> Column:
    """struct(kind, number, text) of a new value for a cell that had a kind and a number format: a date (as its serial number) where the cell showed dates and
    the value is one, a number where it had one or the value looks like one, else text. Blank values are blank text."""
    value = F.trim(F.coalesce(raw, F.lit("")))
    date = F.coalesce(F.try_to_date(value, "M/d/yyyy"), F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "MMM d, yyyy"), F.try_to_date(value, "MMMM d, yyyy"))
    serial = F.datediff(date, F.lit("1899-12-30").cast("date")).cast("double")
    dated = ((kind == "d") | F.coalesce(F.lower(format_).rlike("[ymdhs]"), F.lit(False))) & date.isNotNull()
    number = F.regexp_replace(F.regexp_replace(value, r"[$,\s]", ""), "%$", "").try_cast("double")
    numeric = ((kind == "n") | value.rlike(r"^[-$]?\d[\d,]*(\.\d+)?%?$")) & number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    said = lambda k, n, t: F.struct(F.lit(k).alias("kind"), n.cast("double").alias("number"), t.cast("string").alias("text"))
    none = F.lit(None)
    return F.when(value == "", said("s", none, F.lit(""))).when(dated, said("d", serial, none)).when(F.coalesce(numeric, F.lit(False)), said("n", number, none)).otherwise(said("s", none, value))


def fill(data: bytes, values: list[tuple[int, int, str, float | None, str | None]]) -> bytes:
    """The workbook with cells (row, col, kind, number, text) set on its first sheet; they keep their style, and lose their formula. All else stays."""
    ElementTree.register_namespace("", _MAIN)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = first_sheet(z)
        root = ElementTree.fromstring(z.read(sheet))
        rows = root.find(f"{_NS}sheetData")
        held = {int(r.get("r")): r for r in rows}
        for row, col, kind, number, text in sorted(values):
            if row not in held:
                held[row] = ElementTree.Element(f"{_NS}row", {"r": str(row)})
                rows.insert(sum(int(r.get("r")) < row for r in rows), held[row])
            at = f"{column_name(col)}{row}"
            cell = next((c for c in held[row] if c.get("r") == at), None)
            if cell is None:
                cell = ElementTree.Element(f"{_NS}c", {"r": at})
                held[row].insert(sum(column_number(c.get("r")) < col for c in held[row]), cell)
            for x in list(cell):
                cell.remove(x)
            cell.attrib.pop("t", None)
            if kind == "s":
                cell.set("t", "inlineStr")
                ElementTree.SubElement(ElementTree.SubElement(cell, f"{_NS}is"), f"{_NS}t").text = text
            else:
                ElementTree.SubElement(cell, f"{_NS}v").text = re.sub(r"\.0$", "", repr(number))
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
            for item in z.infolist():
                to.writestr(item, ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True) if item.filename == sheet else z.read(item.filename))
    return out.getvalue()


def filled(files: DataFrame, values: DataFrame) -> DataFrame:
    """(path, content) of templates (path, content) with values (path, row_index, header, value) written back: row_index counts rows below the header
    from 0, headers that a template doesn't show are passed over. A template is one row, so it is rewritten where it lies; its cells are read twice."""
    cells = read_templates(files)
    at = values.join(shown(cells), ["path", "header"]).withColumn("row", (F.col("header_row") + 1 + F.col("row_index")).cast("int"))
    had = at.join(cells.select("path", "row", "col", "kind", "format"), ["path", "row", "col"], "left")
    new = had.select("path", "row", "col", coerced(F.col("value"), F.coalesce("kind", F.lit("")), F.col("format")).alias("v"))
    lists = new.groupBy("path").agg(F.collect_list(F.struct("row", "col", "v.kind", "v.number", "v.text")).alias("vs"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, vs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                out = fill(content.as_py(), [(v["row"], v["col"], v["kind"], v["number"], v["text"]) for v in vs.as_py() or ()])
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()], pa.string()), pa.array([out], pa.binary())], ["path", "content"])

    return files.select("path", "content").join(lists, "path", "left").mapInArrow(write, "path string, content binary")
