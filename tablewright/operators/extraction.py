"""Around the extraction itself: slots, candidates, tags, drawings, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import BENCHMARK_WORDS, benchmark_words
from ..sources.tables import EXTRACTED, extracted, table
from .geometry import LEDGER, ledger_words


def slots(marks: DataFrame, doc: str = "file", order: str = "seq") -> DataFrame:
    """Each mark's slot: its index among the marks of its page."""
    return marks.withColumn("slot", F.row_number().over(Window.partitionBy(doc, "page").orderBy(order)) - 1)


def apply_updates(slotted: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """Puts each update (keys, value) on its slot, in whatever order they come. Updates without a slot are ignored; a slot
    that was answered with nothing is present and empty, one without an answer stays pending."""
    u = updates.select(*keys, F.col("value").alias("_value"), F.lit(True).alias("_answered"))
    out = slotted.join(u, keys, "left")
    return out.withColumn("value", F.when(F.col("_answered"), F.col("_value")).otherwise(F.col("value"))).withColumn("has_result", F.coalesce("_answered", F.lit(False))).drop("_value", "_answered")


def slot_updates(spark, sf_dir: str) -> DataFrame:
    """A third of the slots is answered, a third of those with nothing; some answers are for slots that don't exist."""
    marks = slots(extracted(spark, sf_dir))
    answers = marks.filter("seq % 3 = 0").select("file", "page", F.when(F.col("seq") % 15 == 0, F.lit(99)).otherwise(F.col("slot")).alias("slot"), F.when(F.col("seq") % 9 == 0, None).otherwise(F.concat(F.lit("new "), "field")).alias("value")).filter("slot <> 99 OR file % 2 = 0")
    return apply_updates(marks.withColumn("value", F.lit(None).cast("string")), answers.dropDuplicates(["file", "page", "slot"]), ["file", "page", "slot"]).select("seq", "file", "page", "slot", "value", "has_result")


SLOT_UPDATES = f"""WITH {EXTRACTED} SELECT seq, file, page, CAST(row_number() OVER (PARTITION BY file, page ORDER BY seq) - 1 AS INTEGER) AS slot,
  CASE WHEN seq % 3 = 0 AND seq % 15 <> 0 AND seq % 9 <> 0 THEN 'new ' || field END AS value, seq % 3 = 0 AND seq % 15 <> 0 AS has_result FROM extracted"""


def prefer_in_table(candidates: DataFrame, tables: DataFrame, table_only: bool = False) -> DataFrame:
    """One candidate (doc, seq, x, y) per document: the only one; else the first inside a table (doc, t_x0, t_y0, t_x1, t_y1); else the
    first. With table_only, one inside a table or none."""
    found = _candidates(candidates, tables)
    pick = F.col("within") if table_only else _preferred()
    return found.select("doc", pick.alias("p")).select("doc", "p.seq", "p.x", "p.y")


def _candidates(candidates: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc, n, first, within) of documents with candidates. A document's candidates and tables are gathered in one aggregation, which a task sorts once; a
    join would sort each side and the aggregation after it a third time."""
    place, box = F.struct("seq", "x", "y"), F.struct("t_x0", "t_y0", "t_x1", "t_y1")
    both = candidates.select("doc", place.alias("place")).unionByName(tables.filter("doc is not null").select("doc", box.alias("box")), allowMissingColumns=True)
    gathered = both.groupBy("doc").agg(F.collect_list("place").alias("places"), F.collect_list("box").alias("boxes")).filter(F.size("places") > 0)
    inside = lambda p: F.coalesce(F.exists("boxes", lambda b: p["x"].between(b["t_x0"], b["t_x1"]) & p["y"].between(b["t_y0"], b["t_y1"])), F.lit(False))
    return gathered.select("doc", F.size("places").alias("n"), F.array_min("places").alias("first"), F.array_min(F.filter("places", inside)).alias("within"))


def _preferred() -> Column:
    return F.when(F.col("n") == 1, F.col("first")).otherwise(F.coalesce("within", "first"))


def table_preference(spark, sf_dir: str) -> DataFrame:
    """Middles of the ledger's tax cells, and a table over its third to fifth line."""
    w = ledger_words(spark, sf_dir).filter("x1 = 350")
    c = w.select("doc", F.struct("line", "text").alias("seq"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    tables = c.select("doc").distinct().select("doc", F.lit(0.0).alias("t_x0"), F.lit(36.0).alias("t_y0"), F.lit(400.0).alias("t_x1"), F.lit(70.0).alias("t_y1"))
    both = F.array(*[F.struct(F.lit(only).alias("only"), p.alias("p")) for only, p in ((False, _preferred()), (True, F.col("within")))])
    out = _candidates(c, tables).select("doc", F.explode(both).alias("b"))
    return out.select("doc", "b.only", F.col("b.p.seq.line").alias("line"), "b.p.x", "b.p.y")


TABLE_PREFERENCE = f"""WITH {LEDGER}, c AS (SELECT doc, line, text, (x0 + x1) / 2 AS x, (y0 + y1) / 2 AS y, (y0 + y1) / 2 BETWEEN 36 AND 70 AS inside, count(*) OVER (PARTITION BY doc) AS n FROM words WHERE x1 = 350),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN n = 1 THEN 0 ELSE NOT inside END, line, text, x) AS k, row_number() OVER (PARTITION BY doc ORDER BY NOT inside, line, text, x) AS kt FROM c)
SELECT doc, false AS only, line, x, y FROM r WHERE k = 1 UNION ALL SELECT doc, true, CASE WHEN inside THEN line END, CASE WHEN inside THEN x END, CASE WHEN inside THEN y END FROM r WHERE kt = 1"""


def near_or_all(hits: DataFrame, x: float, y: float, dx: float = 0.35, dy: float = 0.25) -> DataFrame:
    """The hit (doc, x, y in page fractions) nearest to a place, among those within dx and dy of it; if there is none, among all."""
    near = (F.abs(F.col("x") - x) <= dx) & (F.abs(F.col("y") - y) <= dy)
    d = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    best = F.struct(d.alias("d"), F.col("y"), F.col("x"))
    return hits.groupBy("doc").agg(F.coalesce(F.min(F.when(near, best)), F.min(best)).alias("b"), F.max(near).alias("near")).select("doc", "b.x", "b.y", "near")


def search_region(spark, sf_dir: str) -> DataFrame:
    return near_or_all(ledger_words(spark, sf_dir).filter("x1 = 150").select("doc", (F.col("x0") / 612).alias("x"), (F.col("y0") / 96).alias("y")), 0.5, 0.4).select("doc", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "near")


SEARCH_REGION = f"""WITH {LEDGER}, h AS (SELECT doc, x0 / 612 AS x, y0 / 96 AS y FROM words WHERE x1 = 150),
r AS (SELECT *, abs(x - 0.5) <= 0.35 AND abs(y - 0.4) <= 0.25 AS near, (x - 0.5) * (x - 0.5) + (y - 0.4) * (y - 0.4) AS d FROM h)
SELECT doc, round(x, 6) AS x, round(y, 6) AS y, near FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY NOT near, d, y, x) AS k FROM r) WHERE k = 1"""


def without_tags(words: DataFrame) -> DataFrame:
    """Words outside signature tags: from a word that opens one ([text|, [sig| ...) to the next that has a closing bracket, both
    included, all are dropped; so are document id stamps."""
    w = Window.partitionBy("doc", "page").orderBy("line", "word_no")
    opens = F.when(F.col("text").rlike(r"(?i)^\[[a-z]+\|"), F.struct("line", "word_no"))
    closes = F.when(F.contains("text", F.lit("]")), F.struct("line", "word_no"))
    last_open = F.last(opens, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last_close = F.last(closes, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(last_open.isNotNull() & (last_close.isNull() | (last_close < last_open)), F.lit(False))
    return words.withColumn("_in", inside).filter(~F.col("_in") & ~F.col("text").rlike(r"(?i)^Doc\S*ID")).drop("_in")


def tag_skip(spark, sf_dir: str) -> DataFrame:
    """The benchmark with a tag of four words in every twenty of a line."""
    k = F.col("word_no") % 20
    text = F.when(k == 5, "[sig|req").when(k == 8, "signer]").when(k == 12, "DocuSignID").otherwise(F.col("text"))
    return without_tags(benchmark_words(spark, sf_dir).withColumn("text", text)).select("doc", "page", "line", "word_no", "text")


TAG_SKIP = f"""WITH {BENCHMARK_WORDS}, t AS (SELECT doc, page, line, word_no, CASE word_no % 20 WHEN 5 THEN '[sig|req' WHEN 8 THEN 'signer]' WHEN 12 THEN 'DocuSignID' ELSE text END AS text FROM words),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY line, word_no) AS i FROM t),
m AS (SELECT *, max(CASE WHEN text LIKE '[sig|%' THEN i END) OVER (PARTITION BY doc, page ORDER BY i) AS op, max(CASE WHEN contains(text, ']') THEN i END) OVER (PARTITION BY doc, page ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cl FROM ordered)
SELECT doc, page, line, word_no, text FROM m WHERE NOT (op IS NOT NULL AND coalesce(cl, 0) < op) AND text <> 'DocuSignID'"""


def segments(drawings: DataFrame, flat: float = 0.8, thin: float = 1.5, least: float = 1.0) -> DataFrame:
    """Ruling segments (doc, orient, lo, hi, axis) of drawings (doc, kind line or rect, x0, y0, x1, y1): flat lines of some length;
    a thin rect is one segment, any other its four edges."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    left, right, top, bottom = F.least("x0", "x1"), F.greatest("x0", "x1"), F.least("y0", "y1"), F.greatest("y0", "y1")
    seg = lambda o, lo, hi, at: F.struct(F.lit(o).alias("orient"), lo.alias("lo"), hi.alias("hi"), at.alias("axis"))
    flat_h, flat_v = seg("h", left, right, (top + bottom) / 2), seg("v", top, bottom, (left + right) / 2)
    none = F.array().cast("array<struct<orient:string,lo:double,hi:double,axis:double>>")
    line = F.when((h <= flat) & (w >= least), F.array(flat_h)).when((w <= flat) & (h >= least), F.array(flat_v)).otherwise(none)
    rect = F.when((h <= thin) & (w >= least), F.array(flat_h)).when((w <= thin) & (h >= least), F.array(flat_v)).otherwise(F.array(seg("h", left, right, top), seg("h", left, right, bottom), seg("v", top, bottom, left), seg("v", top, bottom, right)))
    return drawings.select("doc", F.explode(F.when(F.col("kind") == "line", line).otherwise(rect)).alias("s")).select("doc", "s.*")


def ruling_segments(spark, sf_dir: str) -> DataFrame:
    """Line items as drawings: lines and rects, some of them thin."""
    d = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS doc", "CASE WHEN l_linenumber % 2 = 0 THEN 'line' ELSE 'rect' END AS kind", "cast(l_partkey % 50 AS double) AS x0", "cast(l_suppkey % 40 AS double) AS y0", "cast(l_partkey % 50 + (l_partkey % 3) * 10 AS double) AS x1", "cast(l_suppkey % 40 + (l_suppkey % 2) * 7 AS double) AS y1")
    return segments(d)


RULING_SEGMENTS = """WITH d AS (SELECT l_orderkey AS doc, l_linenumber % 2 = 0 AS line, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 40 AS DOUBLE) AS y, CAST(l_partkey % 3 * 10 AS DOUBLE) AS w, CAST(l_suppkey % 2 * 7 AS DOUBLE) AS h FROM lineitem),
one AS (SELECT doc, 'h' AS orient, x AS lo, x + w AS hi, y + h / 2 AS axis FROM d WHERE h = 0 AND w > 0 UNION ALL SELECT doc, 'v', y, y + h, x + w / 2 FROM d WHERE w = 0 AND h > 0),
four AS (SELECT * FROM d WHERE NOT line AND NOT (h = 0 AND w > 0) AND NOT (w = 0 AND h > 0))
SELECT * FROM one UNION ALL SELECT doc, 'h', x, x + w, y FROM four UNION ALL SELECT doc, 'h', x, x + w, y + h FROM four UNION ALL SELECT doc, 'v', y, y + h, x FROM four UNION ALL SELECT doc, 'v', y, y + h, x + w FROM four"""


def vector_pages(items: DataFrame) -> DataFrame:
    """Whether a page's text is drawn: 40 items or more over 15% of it, or 5 curves."""
    g = items.groupBy("doc").agg(F.count("*").alias("n_items"), F.count_if(F.col("kind") == "curve").alias("n_curves"), F.sum("area").alias("area"))
    return g.withColumn("is_vector", ((F.col("n_items") >= 40) & (F.col("area") >= 0.15)) | (F.col("n_curves") >= 5))


def vector_classify(spark, sf_dir: str) -> DataFrame:
    """Customers' line items as drawings."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    items = j.select(F.col("o_custkey").alias("doc"), F.when(F.col("l_partkey") % 11 == 0, "curve").otherwise("line").alias("kind"), (F.col("l_partkey") % 16 / F.lit(1024.0)).alias("area"))
    return vector_pages(items)


VECTOR_CLASSIFY = """WITH g AS (SELECT o_custkey AS doc, count(*) AS n_items, count(*) FILTER (l_partkey % 11 = 0) AS n_curves, sum((l_partkey % 16) / 1024.0::DOUBLE) AS area FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT *, (n_items >= 40 AND area >= 0.15) OR n_curves >= 5 AS is_vector FROM g"""

# Fixed patterns of values on a line.
VALUES = {"amount": r"\$\s?[0-9][0-9,]*(?:\.[0-9]{2})?", "date": r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", "year": r"\b(?:19|20)[0-9]{2}\b", "percent": r"\b[0-9]+(?:\.[0-9]+)?\s?%"}


def value_candidates(spark, sf_dir: str) -> DataFrame:
    """What looks like a value in every document, by kind: how many, and the first."""
    d = table(spark, sf_dir, "documents")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("hits")) for k, p in VALUES.items()])
    return d.select("doc_id", F.explode(kinds).alias("x")).filter(F.size("x.hits") > 0).select("doc_id", "x.kind", F.size("x.hits").alias("n"), F.get("x.hits", F.lit(0)).alias("first"))


VALUE_CANDIDATES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, CAST(len(regexp_extract_all(text, '{p}')) AS INTEGER) AS n, regexp_extract_all(text, '{p}')[1] AS first FROM documents WHERE regexp_matches(text, '{p}')" for k, p in VALUES.items())


def first_match(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """The first pattern's group that is found, and its confidence: high for the first two patterns, else medium."""
    found = [F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns]
    value = F.coalesce(*found)
    return value, F.when(F.coalesce(*found[:2]).isNotNull(), "high").when(value.isNotNull(), "medium")


def live_sessions(uses: DataFrame, now: str, ttl: str, cap: int) -> DataFrame:
    """Sessions (session, used_at) that a store still holds: not older than ttl since the first use, and among the cap last used."""
    s = uses.groupBy("session").agg(F.min("used_at").alias("created"), F.max("used_at").alias("used"), F.count("*").alias("n"))
    fresh = s.filter(F.col("created") + F.expr(f"interval {ttl}") > F.lit(now).cast("timestamp_ntz"))
    return fresh.orderBy(F.desc("used"), "session").limit(cap)


def store_sessions(spark, sf_dir: str) -> DataFrame:
    """A limit is the feature here: the store's cap of 40 sessions."""
    e = table(spark, sf_dir, "events").select(F.concat_ws(":", "user_id", F.date_format("ts", "MMdd")).alias("session"), F.col("ts").alias("used_at"))
    return live_sessions(e, "2024-01-20 12:00:00", "36 hours", 40).select("session", "n", F.col("used").cast("string").alias("used"))


STORE_SESSIONS = """WITH s AS (SELECT user_id || ':' || strftime(ts, '%m%d') AS session, min(ts) AS created, max(ts) AS used, count(*) AS n FROM events GROUP BY 1)
SELECT session, n, regexp_replace(CAST(used AS VARCHAR), '0+$', '') AS used FROM s WHERE created + INTERVAL 36 HOUR > TIMESTAMP '2024-01-20 12:00:00' ORDER BY s.used DESC, session LIMIT 40"""


def template_columns(spark, sf_dir: str) -> DataFrame:
    """A file's columns in the order of its template, then the others in the order first seen."""
    canonical = ["signup", "purchase", "click"]
    seen = extracted(spark, sf_dir).filter("value <> '' AND page < 3").groupBy("file", "field").agg(F.min("seq").alias("first"))
    rank = F.array_position(F.array(*[F.lit(c) for c in canonical]), F.col("field"))
    order = Window.partitionBy("file").orderBy(F.when(rank > 0, rank).otherwise(99), "first")
    return seen.select("file", "field", F.row_number().over(order).alias("place"), (rank > 0).alias("in_template"))


TEMPLATE_COLUMNS = f"""WITH {EXTRACTED}, s AS (SELECT file, field, min(seq) AS first, coalesce(list_position(['signup', 'purchase', 'click'], field), 0) AS r FROM extracted WHERE value <> '' AND page < 3 GROUP BY file, field)
SELECT file, field, CAST(row_number() OVER (PARTITION BY file ORDER BY CASE WHEN r > 0 THEN r ELSE 99 END, first) AS INTEGER) AS place, r > 0 AS in_template FROM s"""

QUERIES = {
    "slot_updates": (slot_updates, SLOT_UPDATES),
    "table_preference": (table_preference, TABLE_PREFERENCE),
    "search_region": (search_region, SEARCH_REGION),
    "tag_skip": (tag_skip, TAG_SKIP),
    "ruling_segments": (ruling_segments, RULING_SEGMENTS),
    "vector_classify": (vector_classify, VECTOR_CLASSIFY),
    "value_candidates": (value_candidates, VALUE_CANDIDATES),
    "store_sessions": (store_sessions, STORE_SESSIONS),
    "template_columns": (template_columns, TEMPLATE_COLUMNS),
}
