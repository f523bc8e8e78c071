"""Where a page's words come from, and what is read of them by place: scans, boxes, selections, stacks, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import is_numeric_token
from ..functions.text import let
from ..sources.layout import BENCHMARK_WORDS, DOCUMENT_WORDS, benchmark_words, document_words
from ..sources.shared import written
from ..sources.tables import EXTRACTED, extracted, table
from .geometry import _REGIONS, LEDGER, PAGE, REGIONS, ledger_words, regions
from .pages import combined, joined_texts

#: Points per inch of a page, and pixels per inch of its image.
PIXELS = 150.0 / 72.0
#: Words of a page's own that make reading its image unnecessary.
ENOUGH_WORDS = 150
#: Items that aren't blank, of a page that isn't a scan.
ENOUGH_ITEMS = 10


def client_status(chars: Column, letters: Column) -> Column:
    """ocr for pages of under 50 characters or 20 ASCII letters, else native."""
    return F.when((chars < 50) | (letters < 20), "ocr").otherwise("native")


def client_page_classify(spark, sf_dir: str) -> DataFrame:
    """Every document as a page, its lines as items, which are joined without a space."""
    joined = F.replace("text", F.lit("\n"), F.lit(""))
    chars, letters = F.char_length(joined), F.regexp_count(joined, F.lit("[a-zA-Z]"))
    return table(spark, sf_dir, "documents").select("doc_id", chars.alias("char_count"), client_status(chars, letters).alias("status"))


CLIENT_PAGE_CLASSIFY = """WITH d AS (SELECT doc_id, replace(text, chr(10), '') AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS char_count, CASE WHEN length(t) < 50 OR len(regexp_extract_all(t, '[a-zA-Z]')) < 20 THEN 'ocr' ELSE 'native' END AS status FROM d"""


def scanned_pages(items: DataFrame) -> DataFrame:
    """Pages by whether they have fewer than ENOUGH_ITEMS items that aren't blank."""
    return items.groupBy(*PAGE).agg((F.count_if(F.trim("text") != "") < ENOUGH_ITEMS).alias("scanned"))


def scanned_pages_query(spark, sf_dir: str) -> DataFrame:
    return scanned_pages(document_words(spark, sf_dir))


SCANNED_PAGES = f"WITH {DOCUMENT_WORDS} SELECT doc, page, count(*) FILTER (trim(text) <> '') < 10 AS scanned FROM words GROUP BY doc, page"


def choose_words(native: DataFrame, read: DataFrame, pages: DataFrame, words: Column | None = None) -> DataFrame:
    """Words of each page with their source: the page's own if it isn't to be read from its image (pages: doc, page, is_ocr), or has ENOUGH_WORDS of
    them; else those read from the image; of pages where nothing was read, the page's own after all. Rows may stand for as many words as `words` says."""
    n = F.lit(1) if words is None else words
    counts = native.select(*PAGE, n.alias("n"), F.lit(False).alias("read")).unionByName(read.select(*PAGE, F.lit(0).alias("n"), F.lit(True).alias("read")))
    facts = counts.unionByName(pages.select(*PAGE, (~F.col("is_ocr")).alias("own"), F.lit(True).alias("known")), allowMissingColumns=True)
    known = facts.groupBy(*PAGE).agg(F.coalesce(F.bool_or("own") | (F.bool_or("known") & (F.coalesce(F.sum("n"), F.lit(0)) >= ENOUGH_WORDS)), F.lit(False)).alias("own"), F.bool_or("read").alias("read"))
    ocr = read.join(known.filter("own"), PAGE, "left_anti").withColumn("source", F.lit("ocr"))
    return native.join(known.filter("read and not own"), PAGE, "left_anti").withColumn("source", F.lit("native")).unionByName(ocr)


def word_sources(spark, sf_dir: str) -> DataFrame:
    """Documents' pages; two thirds are to be read from images, of which every fifth gives nothing, the others the words with an o before them, 2 points to the right."""
    native = document_words(spark, sf_dir)
    own, read = F.struct("text", "x0", "y1"), F.struct(F.concat(F.lit("o"), "text").alias("text"), (F.col("x0") + 2).alias("x0"), "y1")
    # words are laid out once, and counted where they are: what is moved, and chosen from, is a row for each page and source
    each = native.select(*PAGE, F.posexplode(F.when(F.col("doc") % 5 != 0, F.array(own, read)).otherwise(F.array(own))).alias("read", "w")).select(*PAGE, "read", "w.*")
    least = combined(each.withColumn("n", F.lit(1).cast("long")), [*PAGE, "read"], {"n": "sum", "x0": "min", "y1": "max", "text": "min"})
    found = written(least.select(*PAGE, "read", F.col("n").alias("n_words"), F.round(F.col("x0") * PIXELS, 6).alias("x0"), F.round(F.col("y1") * PIXELS, 6).alias("y1"), F.col("text").alias("least")), "sources")
    native, read = (found.filter(F.col("read") == k).drop("read") for k in (0, 1))
    chosen = choose_words(native, read, native.select(*PAGE, (F.col("doc") % 3 != 0).alias("is_ocr")), F.col("n_words"))
    return chosen.select(*PAGE, "source", "n_words", "x0", "y1", "least")


WORD_SOURCES = f"""WITH {DOCUMENT_WORDS}, n AS (SELECT doc, page, doc % 3 <> 0 AND count(*) < 150 AND doc % 5 <> 0 AS ocr FROM words GROUP BY doc, page)
SELECT doc, page, CASE WHEN ocr THEN 'ocr' ELSE 'native' END AS source, count(*) AS n_words, round(min(CASE WHEN ocr THEN x0 + 2 ELSE x0 END) * (150.0::DOUBLE / 72.0::DOUBLE), 6) AS x0, round(max(y1) * (150.0::DOUBLE / 72.0::DOUBLE), 6) AS y1, min(CASE WHEN ocr THEN 'o' || text ELSE text END) AS least
FROM words JOIN n USING (doc, page) GROUP BY doc, page, ocr"""


def words_in_box(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words with the box (region, page, a0, b0, a1, b1) that their centre lies in, by both axes."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.filter(F.trim("text") != "").join(boxes, "page").filter(cx.between(F.col("a0"), F.col("a1")) & cy.between(F.col("b0"), F.col("b1")))


def words_in_box_query(spark, sf_dir: str) -> DataFrame:
    hit = words_in_box(document_words(spark, sf_dir, last_page=max(r[1] for r in REGIONS)), regions(spark))
    return hit.groupBy("doc", "page", "region").agg(F.count("*").alias("n_words"), F.min_by("text", F.struct("y0", "x0")).alias("first"))


WORDS_IN_BOX = f"""WITH {DOCUMENT_WORDS}, {_REGIONS}
SELECT doc, page, region, count(*) AS n_words, arg_min(text, y0 * 1000000 + x0) AS first FROM words JOIN r USING (page) WHERE (x0 + x1) / 2 BETWEEN a0 AND a1 AND (y0 + y1) / 2 BETWEEN b0 AND b1 GROUP BY doc, page, region"""


def selected_rows(spark, sf_dir: str) -> DataFrame:
    """Fields of the documents that are selected: users who sign up after the 20th day."""
    rows = extracted(spark, sf_dir)
    return rows.join(rows.filter((F.col("field") == "signup") & (F.col("page") > 20)).select("file"), "file", "left_semi").select("seq", "file", "value")


SELECTED_ROWS = f"WITH {EXTRACTED} SELECT seq, file, value FROM extracted WHERE file IN (SELECT file FROM extracted WHERE field = 'signup' AND page > 20)"


def stacked(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Rows of all pages under each other, the page's number as their first cell."""
    return rows.withColumn(cells, F.concat(F.array(F.col("page").cast("string")), F.col(cells)))


def stacked_pages(spark, sf_dir: str) -> DataFrame:
    """Lines of all benchmark items as rows of cells."""
    w = benchmark_words(spark, sf_dir)
    rows = w.groupBy(*PAGE, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]).alias("cells"))
    return stacked(rows).select("doc", "line", F.array_join("cells", "|").alias("row"))


STACKED_PAGES = f"WITH {BENCHMARK_WORDS} SELECT doc, line, page || '|' || string_agg(text, '|' ORDER BY word_no) AS row FROM words GROUP BY doc, page, line"

EDGES = (40.0, 151.0, 251.0)


def edge_column(edges: Column) -> Column:
    """A word's column under right-hand borders: numbers by their right edge, text by its left; beyond the last border, one more column."""
    anchor = F.when(is_numeric_token(F.col("text")), F.col("x1")).otherwise(F.col("x0"))
    return let(anchor, lambda a: F.size(F.filter(edges, lambda b: b < a)))


def edge_cells(spark, sf_dir: str) -> DataFrame:
    """The ledger's rows as cells; a month that is as wide as a number goes by its left edge."""
    w = ledger_words(spark, sf_dir).withColumn("col", edge_column(F.array(*[F.lit(x) for x in EDGES])))
    return joined_texts(w, [*PAGE, "line", "col"], ["x0"])


EDGE_CELLS = f"""WITH {LEDGER}, c AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9.,]+$') THEN x1 ELSE x0 END AS anchor FROM words)
SELECT doc, page, line, CAST((anchor > 40)::INT + (anchor > 151)::INT + (anchor > 251)::INT AS INTEGER) AS col, string_agg(text, ' ' ORDER BY x0, text) AS text FROM c GROUP BY 1, 2, 3, 4"""


def rotated_box(x: Column, y: Column, width: Column, height: Column, a: Column, b: Column, page_height: Column) -> dict[str, Column]:
    """Box, from the page's top, of a run that starts at (x, y) from its bottom and goes in the direction (a, b)."""
    angle = F.atan2(b, a)
    cos, sin = F.cos(angle), F.sin(angle)
    xs = (x, x + width * cos, x - height * sin, x + width * cos - height * sin)
    ys = (y, y + width * sin, y + height * cos, y + width * sin + height * cos)
    return {"left": F.least(*xs), "right": F.greatest(*xs), "top": page_height - F.greatest(*ys), "bottom": page_height - F.least(*ys)}


def rotated_boxes(spark, sf_dir: str) -> DataFrame:
    """Parts as runs in twelve directions."""
    p = table(spark, sf_dir, "part")
    k, d = F.col("p_partkey"), lambda c: c.cast("double")
    box = rotated_box(d(k % 500), d(k % 700), d(F.char_length("p_name") * 6), F.lit(12.0), F.cos(F.radians(k % 12 * 30)), F.sin(F.radians(k % 12 * 30)), F.lit(792.0))
    return p.select("p_partkey", *[(F.round(c, 4) + 0.0).alias(n) for n, c in box.items()])


ROTATED_BOXES = """WITH p AS (SELECT p_partkey, p_partkey % 500 AS x, p_partkey % 700 AS y, length(p_name) * 6 AS w, cos(radians(p_partkey % 12 * 30)) AS c, sin(radians(p_partkey % 12 * 30)) AS s FROM part)
SELECT p_partkey, round(least(x, x + w * c, x - 12 * s, x + w * c - 12 * s), 4) + 0.0::DOUBLE AS "left", round(greatest(x, x + w * c, x - 12 * s, x + w * c - 12 * s), 4) + 0.0::DOUBLE AS "right",
  round(792 - greatest(y, y + w * s, y + 12 * c, y + w * s + 12 * c), 4) + 0.0::DOUBLE AS top, round(792 - least(y, y + w * s, y + 12 * c, y + w * s + 12 * c), 4) + 0.0::DOUBLE AS bottom FROM p"""


def cell_text(words: DataFrame, keys: list[str]) -> DataFrame:
    """Text of each cell, line by line: a word starts a new line if its top is more than 0.6 of the upper median height (2.5 points at least) from the
    top of the line's first word."""
    item = F.struct("y0", "x0", "text")
    heights = F.sort_array(F.collect_list(F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))))
    cells = words.filter(F.trim("text") != "").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("ws"), heights.alias("hs"))
    cells = cells.withColumn("tol", F.greatest(F.coalesce(F.get("hs", F.expr("cast(size(hs) div 2 as int)")), F.lit(10.0)) * 0.6, F.lit(2.5)))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<array<struct<x0:double,text:string>>>").alias("lines"))

    def step(acc, w):
        lines, word = acc["lines"], F.struct(w["x0"].alias("x0"), F.trim(w["text"]).alias("text"))
        same = F.abs(w["y0"] - acc["at"]) <= F.col("tol")
        more = F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.array_append(F.get(lines, F.size(lines) - 1), word)))
        return F.when(same, F.struct(acc["at"].alias("at"), more.alias("lines"))).otherwise(F.struct(w["y0"].alias("at"), F.array_append(lines, F.array(word)).alias("lines")))

    said = F.transform(F.aggregate("ws", start, step, lambda a: a["lines"]), lambda line: F.array_join(F.transform(F.array_sort(line), lambda x: x["text"]), " "))
    return cells.select(*keys, F.array_join(said, "\n").alias("text"))


def cell_texts(spark, sf_dir: str) -> DataFrame:
    """Each order's ledger as one cell; words of a line are up to 3 points lower from left to right."""
    w = ledger_words(spark, sf_dir)
    drop = F.least(F.floor(F.col("x0") / 100), F.lit(3)).cast("double")
    return cell_text(w.withColumns({"y0": F.col("y0") + drop, "y1": F.col("y1") + drop}), PAGE)


CELL_TEXTS = f"""WITH {LEDGER}, l AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x0, text) AS t FROM words GROUP BY doc, page, line)
SELECT doc, page, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY doc, page"""


def find_item(words: DataFrame, query: str, width: float = 612.0, height: float = 792.0, pad: float = 3.0) -> DataFrame:
    """Each page's item that contains the most of the query's words (of two characters or more), the topmost of the best, as a box of page
    fractions with some room around it."""
    asked = [w for w in query.lower().split() if len(w) > 1]
    score = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in asked), F.lit(0))
    best = words.withColumn("score", score).filter("score > 0").groupBy(*PAGE).agg(F.min(F.struct((-F.col("score")).alias("s"), "y0", "x0", "x1", "y1", "text")).alias("b"))
    x0, y0 = F.greatest(F.lit(0.0), F.col("b.x0") - pad), F.greatest(F.lit(0.0), F.col("b.y0") - pad)
    x1, y1 = F.least(F.lit(width), F.col("b.x1") + pad), F.least(F.lit(height), F.col("b.y1") + pad)
    return best.select(*PAGE, "b.text", (x0 / width).alias("x"), (y0 / height).alias("y"), ((x1 - x0) / width).alias("width"), ((y1 - y0) / height).alias("height"))


def find_items(spark, sf_dir: str) -> DataFrame:
    out = find_item(benchmark_words(spark, sf_dir), "a The on")
    return out.select(*PAGE, "text", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


FIND_ITEMS = f"""WITH {BENCHMARK_WORDS}, s AS (SELECT *, contains(lower(text), 'the')::INT + contains(lower(text), 'on')::INT AS score FROM words),
b AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY score DESC, y0, x0, x1, y1, text) AS k FROM s WHERE score > 0),
c AS (SELECT doc, page, text, greatest(0.0::DOUBLE, x0 - 3) AS l, greatest(0.0::DOUBLE, y0 - 3) AS t, least(612.0::DOUBLE, x1 + 3) AS r, least(792.0::DOUBLE, y1 + 3) AS u FROM b WHERE k = 1)
SELECT doc, page, text, round(l / 612.0::DOUBLE, 6) AS x, round(t / 792.0::DOUBLE, 6) AS y, round((r - l) / 612.0::DOUBLE, 6) AS width, round((u - t) / 792.0::DOUBLE, 6) AS height FROM c"""

QUERIES = {
    "client_page_classify": (client_page_classify, CLIENT_PAGE_CLASSIFY),
    "scanned_pages": (scanned_pages_query, SCANNED_PAGES),
    "word_sources": (word_sources, WORD_SOURCES),
    "words_in_box": (words_in_box_query, WORDS_IN_BOX),
    "selected_rows": (selected_rows, SELECTED_ROWS),
    "stacked_pages": (stacked_pages, STACKED_PAGES),
    "edge_cells": (edge_cells, EDGE_CELLS),
    "rotated_boxes": (rotated_boxes, ROTATED_BOXES),
    "cell_texts": (cell_texts, CELL_TEXTS),
    "find_items": (find_items, FIND_ITEMS),
}
