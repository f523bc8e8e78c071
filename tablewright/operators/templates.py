"""Marks of a document as a template: for its other pages, and for other documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import table


def apply_to_pages(marks: DataFrame, pages: DataFrame, chosen: Column | None = None) -> DataFrame:
    """marks (doc, mark, page, ...) after a document's marks, or those chosen, were copied to each of its pages (doc, page) that has none of them, at the
    same place; with copied. What else is on those pages stays: without a choice that is nothing."""
    source = marks if chosen is None else marks.filter(chosen)
    own = source.select("doc", "page").distinct()
    rest = [c for c in marks.columns if c not in ("doc", "page")]
    to = pages.join(source.select("doc").distinct(), "doc", "left_semi").join(own, ["doc", "page"], "left_anti")
    copies = to.join(source.select("doc", *rest), "doc").select("doc", "page", *rest).withColumn("copied", F.lit(True))
    return marks.select("doc", "page", *rest).withColumn("copied", F.lit(False)).unionByName(copies)


def apply_to_documents(marks: DataFrame, targets: DataFrame, starts: DataFrame) -> DataFrame:
    """marks after other documents took a document's marks in place of their own: targets (source, doc), starts (doc, start, total). A page that
    follows the source's first page by n goes to the page that follows the target's by n, if there is one; a total that isn't known yet bounds nothing."""
    at = starts.select("doc", F.coalesce("start", F.lit(1)).alias("start"), "total")
    rest = [c for c in marks.columns if c not in ("doc", "page")]
    taken = marks.join(at.select("doc", F.col("start").alias("_from")), "doc").withColumnRenamed("doc", "source").join(targets.select("source", "doc"), "source").join(at, "doc")
    page = (F.col("start") + F.col("page") - F.col("_from")).cast("int")
    copies = taken.withColumn("page", page).filter((F.col("page") >= 1) & (F.col("total").isNull() | (F.col("page") <= F.col("total")))).select("doc", "page", *rest)
    return marks.join(targets.select("doc"), "doc", "left_anti").select("doc", "page", *rest).unionByName(copies)


def _pages(spark, sf_dir: str) -> DataFrame:
    """Customers as documents, their orders as pages; every fifth order is marked."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(w).alias("page"), F.col("o_orderkey").alias("mark"))


def apply_all_pages(spark, sf_dir: str) -> DataFrame:
    """The marks that two divides, to all other pages of their customer."""
    pages = _pages(spark, sf_dir)
    return apply_to_pages(pages.filter("mark % 5 = 0"), pages.select("doc", "page"), F.col("mark") % 2 == 0)


_PAGES = "p AS (SELECT o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page, o_orderkey AS mark FROM orders), m AS (SELECT * FROM p WHERE mark % 5 = 0)"
APPLY_ALL_PAGES = f"""WITH {_PAGES}, s AS (SELECT * FROM m WHERE mark % 2 = 0)
SELECT doc, page, mark, false AS copied FROM m UNION ALL SELECT p.doc, p.page, s.mark, true FROM p JOIN s USING (doc) WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc = p.doc AND o.page = p.page)"""


def apply_all_documents(spark, sf_dir: str) -> DataFrame:
    """Every tenth customer's marks, to the nine after; documents start on their first to third page, and every seventh doesn't know its length."""
    pages = _pages(spark, sf_dir)
    source = F.expr("doc div 10 * 10")
    docs = pages.groupBy("doc").agg(F.max("page").alias("n"))
    starts = docs.select("doc", F.when(F.col("doc") % 4 == 0, None).otherwise((F.col("doc") % 3 + 1).cast("int")).alias("start"), F.when(F.col("doc") % 7 == 0, None).otherwise(F.col("n")).alias("total"))
    return apply_to_documents(pages.filter("mark % 5 = 0"), docs.filter(F.col("doc") % 10 != 0).select(source.alias("source"), "doc"), starts)


APPLY_ALL_DOCUMENTS = f"""WITH {_PAGES}, d AS (SELECT doc, max(page) AS n, CASE WHEN doc % 4 = 0 THEN 1 ELSE CAST(doc % 3 + 1 AS INTEGER) END AS start, CASE WHEN doc % 7 = 0 THEN NULL ELSE max(page) END AS total FROM p GROUP BY doc),
c AS (SELECT t.doc, CAST(t.start + m.page - s.start AS INTEGER) AS page, m.mark, t.total FROM m JOIN d s ON s.doc = m.doc JOIN d t ON t.doc // 10 * 10 = m.doc AND t.doc % 10 <> 0)
SELECT doc, page, mark FROM m WHERE doc % 10 = 0 UNION ALL SELECT doc, page, mark FROM c WHERE page >= 1 AND (total IS NULL OR page <= total)"""

QUERIES = {"apply_all_pages": (apply_all_pages, APPLY_ALL_PAGES), "apply_all_documents": (apply_all_documents, APPLY_ALL_DOCUMENTS)}
