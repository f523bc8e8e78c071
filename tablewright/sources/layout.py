"""Text as positioned words: 6 points a character, 12 points a line, 50 lines a page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import table

CHAR, LINE, PAGE_LINES = 6.0, 12.0, 50
#: Words whose offsets are folded at a time; appending to an array copies it.
STRIDE = 32


def words(texts: DataFrame, id_col: str, text_col: str = "text", last_page: int | None = None) -> DataFrame:
    """Rows (doc, page, line, word_no, text, x0, y0, x1, y1): words between single spaces, with their box, up to last_page if given. A
    word's offset in its line is folded from the lengths before it, in strides and then over the strides, so a text is laid out where
    it is read, without a shuffle."""
    lines = texts.select(F.col(id_col).alias("doc"), F.posexplode(F.split(text_col, "\n")).alias("row", "_line"))
    if last_page:
        lines = lines.filter(F.col("row") < last_page * PAGE_LINES)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<w:string,at:int>>").alias("out"))
    step = lambda a, w: F.struct((a["at"] + F.char_length(w) + 1).alias("at"), F.array_append(a["out"], F.struct(w.alias("w"), a["at"].alias("at"))).alias("out"))
    lines = lines.withColumn("_words", F.split("_line", " ")).withColumn("_strides", F.sequence(F.lit(0), F.expr(f"(size(_words) - 1) div {STRIDE}").cast("int")))
    lines = lines.select("doc", "row", F.transform("_strides", lambda k: F.aggregate(F.slice("_words", k * STRIDE + 1, F.lit(STRIDE)), start, step)).alias("_strides"))
    before = F.aggregate("_strides", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, s: F.struct((a["at"] + s["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    strides = lines.select("doc", "row", F.posexplode(F.arrays_zip(F.col("_strides.out").alias("ws"), before.alias("base"))).alias("k", "s"))
    placed = strides.select("doc", "row", "k", F.col("s.base").alias("base"), F.posexplode("s.ws").alias("i", "x")).filter(F.col("x.w") != "")
    placed = placed.select("doc", "row", (F.col("k") * STRIDE + F.col("i")).alias("word_no"), F.col("x.w").alias("w"), (F.col("base") + F.col("x.at")).alias("at"))
    y0 = (F.col("row") % PAGE_LINES) * LINE
    return placed.select(
        "doc", F.expr(f"row div {PAGE_LINES} + 1").cast("int").alias("page"), F.col("row").alias("line"), "word_no", F.col("w").alias("text"),
        (F.col("at") * CHAR).alias("x0"), y0.alias("y0"), ((F.col("at") + F.char_length("w")) * CHAR).alias("x1"), (y0 + LINE - 2).alias("y1"),
    )


def words_sql(source: str, id_col: str) -> str:
    return f"""l AS (SELECT {id_col} AS doc, unnest(string_split(text, chr(10))) AS line_text, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INTEGER) AS row FROM {source}),
w AS (SELECT doc, row, unnest(string_split(line_text, ' ')) AS t, CAST(unnest(range(0, len(string_split(line_text, ' ')))) AS INTEGER) AS word_no FROM l),
o AS (SELECT *, coalesce(sum(length(t) + 1) OVER (PARTITION BY doc, row ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off0 FROM w),
words AS (SELECT doc, row // 50 + 1 AS page, row AS line, word_no, t AS text, CAST(off0 * 6 AS DOUBLE) AS x0, CAST(row % 50 * 12 AS DOUBLE) AS y0, CAST((off0 + length(t)) * 6 AS DOUBLE) AS x1, CAST(row % 50 * 12 + 10 AS DOUBLE) AS y1 FROM o WHERE t <> '')"""


def document_words(spark, sf_dir: str, last_page: int | None = None) -> DataFrame:
    return words(table(spark, sf_dir, "documents"), "doc_id", last_page=last_page)


DOCUMENT_WORDS = words_sql("documents", "doc_id")


def benchmark_words(spark, sf_dir: str) -> DataFrame:
    return words(table(spark, sf_dir, "benchmark"), "item_id")


BENCHMARK_WORDS = words_sql("benchmark", "item_id")
