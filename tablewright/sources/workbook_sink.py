"""df.write.format("tablewright_workbooks"): workbooks as a sink that many tasks write at once, and none of it counts before all have."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from urllib.parse import urlparse
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .xlsx import column_name, sheet_names

SCHEMA = "workbook string, sheet string, sheet_no int, row_no long, cells array<string>"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def folder(path: str) -> str:
    """The sink writes by the operating system, so its folder must be one that all executors mount."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"workbooks need a mounted folder, not {path}")
    return at.path


@dataclass
class Written(WriterCommitMessage):
    """Workbooks that a task has finished: temporary file and final name."""

    files: list[tuple[str, str]] = field(default_factory=list)


class WorkbookSource(DataSource):
    """Rows (workbook, sheet, sheet_no, row_no, cells) to <path>/<workbook>.xlsx. All rows of a workbook must be in one partition, in order: see
    arranged. A row without cells makes its sheet without filling it; a sheet without any says (no data)."""

    @classmethod
    def name(cls) -> str:
        return "tablewright_workbooks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WorkbookWriter(self.options["path"], self.options.get("naming", "file"))


class WorkbookWriter(DataSourceWriter):
    """Tasks write under <path>/_temporary/<this write>; commit moves what they finished to its place, abort leaves what was there. A task that is
    lost and run again writes new files, and only those it reports count."""

    def __init__(self, path: str, naming: str):
        self.path, self.naming = folder(path), naming
        self.own = os.path.join(self.path, "_temporary", uuid.uuid4().hex)

    def write(self, iterator: Iterator) -> Written:
        os.makedirs(self.own, exist_ok=True)
        done = Written()
        for book, rows in groupby(iterator, key=lambda r: r.workbook):
            if any(book == name for _, name in done.files):
                raise ValueError(f"rows of workbook {book} aren't together")
            temporary = os.path.join(self.own, f"{uuid.uuid4().hex}.xlsx")
            write_workbook(temporary, rows, self.naming)
            done.files.append((temporary, book))
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("rows of one workbook came in several partitions")
        for temporary, name in files:
            os.replace(temporary, os.path.join(self.path, f"{name.replace(os.sep, '_')}.xlsx"))
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for d in (self.own, os.path.dirname(self.own)):
            try:
                for f in os.listdir(d) if d == self.own else ():
                    os.unlink(os.path.join(d, f))
                os.rmdir(d)
            except OSError:
                pass


def write_workbook(path: str, rows: Iterator, naming: str) -> None:
    """One workbook of rows in order; a sheet is streamed to the file as its rows come."""
    wanted = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for _, of in groupby(rows, key=lambda r: (r.sheet_no, r.sheet)):
            n = 0
            first = next(of)
            wanted.append(first.sheet or "")
            with z.open(f"xl/worksheets/sheet{len(wanted)}.xml", "w") as out:
                out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for cells in (r.cells for part in ((first,), of) for r in part):
                    if cells is not None:
                        n += 1
                        out.write(row_xml(n, cells).encode())
                if not n:
                    out.write(row_xml(1, ["(no data)"]).encode())
                out.write(b"</sheetData></worksheet>")
        names = sheet_names(wanted, naming)
        sheets = range(1, len(names) + 1)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in sheets)
        z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>')
        z.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(sheets, names, strict=True))
        z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{tabs}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in sheets) + "</Relationships>")


def row_xml(n: int, cells: list[str | None]) -> str:
    held = (f'<c r="{column_name(c)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for c, v in enumerate(cells) if v)
    return f'<row r="{n}">{"".join(held)}</row>'


def arranged(rows: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Rows (see SCHEMA) as the sink needs them: a workbook to a partition, its sheets and rows in order. sheets (workbook, sheet, sheet_no) names those
    that are there even without rows."""
    if sheets is not None:
        empty = sheets.select("workbook", "sheet", F.col("sheet_no").cast("int").alias("sheet_no"), F.lit(-1).cast("long").alias("row_no"), F.lit(None).cast("array<string>").alias("cells"))
        rows = rows.select("workbook", "sheet", F.col("sheet_no").cast("int").alias("sheet_no"), F.col("row_no").cast("long").alias("row_no"), "cells").unionByName(empty)
    return rows.repartition("workbook").sortWithinPartitions("workbook", "sheet_no", "sheet", "row_no").select("workbook", "sheet", "sheet_no", "row_no", "cells")


def stacked_pages(rows: DataFrame, first_row_header: bool) -> DataFrame:
    """Rows (doc, page, row_no, cells) of all pages as one sheet per document, the page's number before each: with first_row_header a page's first
    row is the header, which is written once, for the first page, and left out on all."""
    numbered = F.concat(F.array(F.col("page").cast("string")), F.col("cells"))
    body = rows.select("doc", F.struct("page", "row_no").alias("at"), numbered.alias("cells"))
    if first_row_header:
        w = Window.partitionBy("doc", "page").orderBy("row_no")
        marked = rows.withColumn("k", F.row_number().over(w))
        head = marked.filter("k = 1").groupBy("doc").agg(F.min_by("cells", "page").alias("cells")).select("doc", F.lit(None).cast("struct<page:int,row_no:long>").alias("at"), F.concat(F.array(F.lit("Page")), F.col("cells")).alias("cells"))
        body = head.unionByName(marked.filter("k > 1").select("doc", F.struct(F.col("page").cast("int").alias("page"), F.col("row_no").cast("long").alias("row_no")).alias("at"), numbered.alias("cells")))
    order = Window.partitionBy("doc").orderBy(F.col("at").asc_nulls_first())
    return body.select(F.col("doc").cast("string").alias("workbook"), F.lit("Table").alias("sheet"), F.lit(0).alias("sheet_no"), F.row_number().over(order).cast("long").alias("row_no"), "cells")
