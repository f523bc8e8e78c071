"""Workbooks: a Spark data source for reading, and a writer, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(ref: str) -> int:
    """0 for A1, 26 for AA3."""
    n = 0
    for ch in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def column_name(n: int) -> str:
    name = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return name


def read_rows(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of the first sheet's cells that hold something."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheet = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else next(n for n in sorted(names) if n.startswith("xl/worksheets/"))
        for _, cell in ElementTree.iterparse(io.BytesIO(z.read(sheet))):
            if cell.tag != f"{_NS}c":
                continue
            value, kind, ref = cell.find(f"{_NS}v"), cell.get("t"), cell.get("r")
            text = "".join(t.text or "" for t in cell.iter(f"{_NS}t")) if kind == "inlineStr" else None if value is None else shared[int(value.text)] if kind == "s" else value.text
            if text is not None:
                if kind in (None, "n") and re.fullmatch(r"-?\d+\.0+", text):
                    text = text.split(".")[0]
                yield int(re.search(r"\d+", ref)[0]), column_number(ref), text


class XlsxSource(DataSource):
    """format("tablewright_xlsx").load(path): rows (path, row, col, text). Files come through binaryFile's path list."""

    @classmethod
    def name(cls) -> str:
        return "tablewright_xlsx"

    def schema(self) -> str:
        return "path string, row int, col int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.path.split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            data = f.read()
        for row, col, text in read_rows(data):
            yield partition.value, row, col, text


def read_workbooks(files: DataFrame) -> DataFrame:
    """Cells of workbooks that spark.read.format("binaryFile") found, wherever they are stored."""

    def read(batches):
        import pandas as pd

        for b in batches:
            out = [(p, *cell) for p, content in zip(b["path"], b["content"], strict=True) for cell in read_rows(bytes(content))]
            yield pd.DataFrame(out, columns=["path", "row", "col", "text"])

    return files.select("path", "content").mapInPandas(read, "path string, row int, col int, text string")


def header_row(cells: DataFrame, within: int = 15) -> DataFrame:
    """Each sheet's header row: of its first rows, the one with most cells that are text (two at least), the earliest of
    equals; else its first row."""
    text = (F.trim("text") != "") & F.col("text").try_cast("double").isNull()
    rows = cells.filter(F.col("row") <= within).groupBy("path", "row").agg(F.count_if(text).alias("n"))
    best = F.max_by("row", F.when(F.col("n") >= 2, F.struct("n", -F.col("row"))))
    return rows.groupBy("path").agg(F.coalesce(best, F.min("row")).alias("header"))


def looks_like_header(first_row: Column, n_rows: Column) -> Column:
    """Whether a table's first row (an array of cells) is a header: there are more rows, and some cell isn't a number."""
    return (n_rows > 1) & F.exists(first_row, lambda c: (F.trim(c) != "") & ~F.regexp_replace(F.trim(c), r"[.\-,]", "").rlike(r"^\d+$"))


#: How workbooks name their sheets: what is cut off, what forbidden characters become, the greatest length, and how a repeated name is cut and numbered.
#: "exact" rules compare names with their case.
NAMINGS = {
    "numbered": {"strip": None, "put": " ", "most": 31, "cut": None, "tail": " ({})", "exact": False, "empty": "Sheet"},
    "page": {"strip": None, "put": None, "most": 31, "cut": 28, "tail": "_{}", "exact": True, "empty": ""},
    "bank": {"strip": None, "put": "-", "most": 31, "cut": None, "tail": " ({})", "exact": True, "empty": "Sheet", "raw": True},
    "utility": {"strip": None, "put": " ", "most": 31, "cut": 28, "tail": " {}", "exact": True, "empty": "Property", "spaces": True},
    "document": {"strip": r"(?i)\.(pdf|docx?)$", "put": "-", "most": 28, "cut": 27, "tail": "_{}", "exact": True, "empty": "Sheet"},
    "file": {"strip": r"\.[^.]+$", "put": "_", "most": 27, "cut": None, "tail": "_{}", "exact": False, "empty": "Sheet", "untrimmed": True},
}


def sheet_names(wanted: list[str], naming: str = "numbered") -> list[str]:
    """Names a workbook accepts, by a rule of NAMINGS: forbidden characters replaced, cut, and numbered from 2 where they would repeat. The bank's
    numbered names are cut from the name as it came."""
    rule, used, out = NAMINGS[naming], set(), []
    seen = (lambda x: x) if rule["exact"] else str.lower
    for w in wanted:
        base = re.sub(rule["strip"], "", w) if rule["strip"] else w
        if rule["put"] is not None:
            base = re.sub(r"[\\/*?:\[\]]", rule["put"], base[:31] if rule.get("raw") else base)
        if rule.get("spaces"):
            base = re.sub(r"\s+", " ", base)
        base = base if rule.get("untrimmed") or rule.get("raw") or naming == "page" else base.strip()
        base = base[: rule["most"]] or rule["empty"]
        name, k = base, 2
        while seen(name) in used:
            tail = rule["tail"].format(k)
            name, k = (w if rule.get("raw") else base)[: rule["cut"] or rule["most"] - len(tail)] + tail, k + 1
        used.add(seen(name))
        out.append(name)
    return out


def workbook(sheets: dict[str, list[list]]) -> bytes:
    """A workbook of sheets, each a list of rows; numbers stay numbers, None is an empty cell."""
    names = sheet_names(list(sheets))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        tabs = "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{tabs}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, rows in enumerate(sheets.values(), 1):
            body = []
            for r, row in enumerate(rows, 1):
                cells = []
                for c, v in enumerate(row):
                    at = f"{column_name(c)}{r}"
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        cells.append(f'<c r="{at}"><v>{v}</v></c>')
                    elif v is not None and v != "":
                        cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
                body.append(f'<row r="{r}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(body)}</sheetData></worksheet>')
    return out.getvalue()


def workbooks(rows: DataFrame, key: str, sheet: str, order: str, cells: list[str]) -> DataFrame:
    """One workbook (key, content) per key, a sheet per value of `sheet`; a key's rows make one file, so they are one group."""

    def write(k, pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        sheets = {str(n): [cells] + [[None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in g[cells].itertuples(index=False)] for n, g in pdf.groupby(sheet, sort=False)}
        return pd.DataFrame({key: [k[0]], "content": [workbook(sheets)]})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(write, f"{key} {kind}, content binary")


def as_tsv(cells: Column) -> Column:
    """A row (array of cells) for the clipboard: tabs between, none within."""
    return F.array_join(F.transform(cells, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]+", " ")), "\t")


def _safe(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def as_html(cells: Column) -> Column:
    """A row (array of cells) as a table row, escaped."""
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<td>"), _safe(c), F.lit("</td>"))), ""), F.lit("</tr>"))


def as_html_spans(cells: Column) -> Column:
    """A row of cells (text, rowspan, colspan) as a table row; spans of one aren't written."""
    span = lambda name, n: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("<td"), span("rowspan", c["rowspan"]), span("colspan", c["colspan"]), F.lit(">"), _safe(c["text"]), F.lit("</td>"))
    return F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, cell), ""), F.lit("</tr>"))
