"""Values of labelled fields, found by where they stand: to the right of the label, else below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.layout import words, words_sql
from ..sources.tables import table

# What counts as beside, how far apart a value's words are, how many it has, and which pages have text.
BAND, OVERLAP, GAP, MOST, LEAST_WORDS, PAD = 0.65, 0.25, 30.0, 6, 10, 2.0
SEPARATOR = r"^[\s:|\-–—•.]+$"
PAGE = ["doc", "page"]


def _key(c: Column) -> Column:
    """Lower case, ASCII letters and digits, single spaces; letters with marks are left out, as Spark has no decomposition."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def _covers(w: Column, left: Column, right: Column | None = None) -> Column:
    """Whether a fair part of the word's width lies between left and right."""
    end = F.least(w["x1"], right) if right is not None else w["x1"]
    return (w["x1"] > w["x0"]) & ((end - F.greatest(w["x0"], left)) / (w["x1"] - w["x0"]) >= OVERLAP)


def _middle(w: Column) -> Column:
    return (w["y0"] + w["y1"]) / 2


def _first(w: Column, *order: str) -> Column:
    """The word's columns, those that order it in front."""
    return F.struct(*[w[c].alias(c) for c in dict.fromkeys([*order, "x0", "line", "word_no", "y0", "x1", "y1", "text"])])


def label_values(items: DataFrame, labels: list[tuple[str, str]]) -> DataFrame:
    """Of words (doc, page, line, word_no, text, x0, y0, x1, y1), each page's value of each field: doc, page, field, value and its box,
    padded. labels are (field, label); a field's first label that finds something counts, each at its first place in the
    page's text.

    The value starts at the first word right of the label that is no separator, and goes on until a wide gap, a word that ends in a colon or
    bar, or its greatest number of words. With nothing to the right it is the topmost word close below. Pages of few words
    count as scanned and have none. The words are shuffled once, by page; a page's words are one array, searched where it lies.
    """
    reading = Window.partitionBy(*PAGE).orderBy("line", "word_no").rowsBetween(Window.unboundedPreceding, -1)
    w = items.withColumn("key", _key(F.col("text")))
    w = w.withColumn("start", F.coalesce(F.sum(F.when(F.col("key") != "", F.char_length("key") + 1)).over(reading), F.lit(0)))
    pages = w.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "word_no", "x0", "y0", "x1", "y1", "text", "key", "start"))).alias("ws")).filter(F.size("ws") >= LEAST_WORDS)
    pages = pages.withColumn("page_text", F.array_join(F.transform(F.filter("ws", lambda x: x["key"] != ""), lambda x: x["key"]), " "))

    asked = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f).alias("field"), _key(F.lit(x)).alias("label")) for i, (f, x) in enumerate(labels)])
    hits = pages.select(*PAGE, "ws", "page_text", F.explode(asked).alias("q")).select(*PAGE, "ws", "q.*", (F.position(F.col("q.label"), F.col("page_text")) - 1).alias("at")).filter("at >= 0 AND label <> ''")

    size, end = lambda x: F.char_length(x["key"]), F.col("at") + F.char_length("label")
    part = lambda x, c: x["x0"] + (c - x["start"]) / size(x) * (x["x1"] - x["x0"])
    shared = F.filter("ws", lambda x: (x["key"] != "") & (x["start"] < end) & (x["start"] + size(x) > F.col("at")))
    sides = lambda x: F.struct(part(x, F.greatest(x["start"], F.col("at"))).alias("left"), part(x, F.least(x["start"] + size(x), end)).alias("right"), x["y0"].alias("top"), x["y1"].alias("bottom"))
    boxes = hits.withColumn("b", F.transform(shared, sides)).select(*PAGE, "rank", "field", "ws", F.array_min("b.left").alias("left"), F.array_max("b.right").alias("right"), F.array_min("b.top").alias("top"), F.array_max("b.bottom").alias("bottom"))
    h = F.col("bottom") - F.col("top")

    beside = F.filter("ws", lambda x: _covers(x, F.col("right") + 1) & (F.abs(_middle(x) - (F.col("top") + F.col("bottom")) / 2) <= h * BAND) & ~x["text"].rlike(SEPARATOR))
    below = F.filter("ws", lambda x: _covers(x, F.col("left") - 5, F.col("right") + h * 4) & _middle(x).between(F.col("bottom") + 1, F.col("bottom") + h * 3))
    seen = boxes.withColumns({"first": F.array_min(F.transform(beside, lambda x: _first(x, "x0"))), "under": F.array_min(F.transform(below, lambda x: _first(x, "y0", "line", "word_no")))})

    fh = F.col("first.y1") - F.col("first.y0")
    line = F.filter("ws", lambda x: _covers(x, F.col("first.x0") - 1) & (F.abs(_middle(x) - (F.col("first.y0") + F.col("first.y1")) / 2) <= fh * BAND))
    kind = "array<struct<x0:double,line:int,word_no:int,y0:double,x1:double,y1:double,text:string>>"

    def go_on(a: Column, x: Column) -> Column:
        n = F.size(a["words"])
        stops = a["done"] | (n >= MOST) | ((n > 0) & ((x["x0"] - F.element_at(a["words"], -1)["x1"] > GAP) | x["text"].rlike(r"[:|]\s*$")))
        return F.struct(F.when(stops, a["words"]).otherwise(F.array_append(a["words"], x)).alias("words"), stops.alias("done"))

    none = F.array().cast(kind)
    chain = F.aggregate(F.array_sort(F.transform(line, lambda x: _first(x, "x0"))).cast(kind), F.struct(none.alias("words"), F.lit(False).alias("done")), go_on, lambda a: a["words"])
    alone = F.array(F.struct(*[F.col(f"under.{c}").alias(c) for c in ("x0", "line", "word_no", "y0", "x1", "y1", "text")])).cast(kind)
    found = seen.withColumn("v", F.when(F.col("first").isNotNull(), chain).when(F.col("under").isNotNull() & ~F.col("under.text").rlike(SEPARATOR), alone).otherwise(none))
    box = [F.greatest(F.array_min("v.x0") - PAD, F.lit(0.0)).alias("x0"), F.greatest(F.array_min("v.y0") - PAD, F.lit(0.0)).alias("y0"), (F.array_max("v.x1") + PAD).alias("x1"), (F.array_max("v.y1") + PAD).alias("y1")]
    # empty ones go after the aggregate: a filter here would be pushed down with all that v is made of, written out again
    best = F.min_by(F.struct(F.array_join("v.text", " ").alias("value"), *box), F.when(F.size("v") > 0, F.col("rank"))).alias("v")
    return found.groupBy(*PAGE, "field").agg(best).filter("v IS NOT NULL").select(*PAGE, "field", "v.*")


LABELS = [("total", "Total due"), ("total", "Amount"), ("status", "Status"), ("clerk", "Sold by")]


def _sheet(sql: bool) -> str:
    """The text of an order's page, in Spark's SQL or DuckDB's; kinds of pages take the branches of the search in turn."""
    nl = "chr(10)"
    p = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)" if sql else "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
    bodies = [
        f"concat('Total due: $ ', {p}, ' USD       Status: ', o_orderstatus)",
        f"concat('Total due : | ', {p}, ' Status: ', o_orderstatus, ' x')",
        f"concat('Total due', {nl}, '   ', {p}, ' more')",
        f"concat('Total due', {nl}, ' --- x')",
        f"concat('Grand TOTAL-DUE ', {p}, ' 2 3 4 5 6 7 8', {nl}, 'Sold', {nl}, 'by ', o_orderpriority)",
        f"concat('Amount ', {p}, ' | Status')",
    ]
    cases = " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(bodies))
    return f"concat(CASE o_orderkey % 7 {cases} ELSE 'Status: none' END, CASE WHEN o_orderkey % 7 < 6 THEN concat({nl}, {nl}, {nl}, {nl}, {nl}, 'We thank you for paying this bill without any delay at all') ELSE '' END)"


def label_search(spark, sf_dir: str) -> DataFrame:
    """Every order as a page."""
    sheets = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_sheet(sql=False)).alias("text"))
    return label_values(words(sheets, "o_orderkey"), LABELS)


def _asked_sql() -> str:
    return "(VALUES " + ", ".join(f"({i}, '{f}', '{x.lower()}')" for i, (f, x) in enumerate(LABELS)) + ") q(rank, field, label)"


LABEL_SEARCH = f"""WITH sheets AS (SELECT o_orderkey, {_sheet(sql=True)} AS text FROM orders), {words_sql("sheets", "o_orderkey")},
k AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key, (y0 + y1) / 2 AS cy, count(*) OVER (PARTITION BY doc, page) AS n FROM words),
s AS (SELECT *, coalesce(sum(CASE WHEN key <> '' THEN length(key) + 1 END) OVER (PARTITION BY doc, page ORDER BY line, word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k WHERE n >= {LEAST_WORDS}),
t AS (SELECT doc, page, string_agg(key, ' ' ORDER BY line, word_no) AS page_text FROM s WHERE key <> '' GROUP BY doc, page),
hits AS (SELECT doc, page, rank, field, label, instr(page_text, label) - 1 AS pos FROM t, {_asked_sql()} WHERE instr(page_text, label) > 0),
boxes AS (SELECT doc, page, rank, field, min(x0 + (greatest(start, pos) - start) / CAST(length(key) AS DOUBLE) * (x1 - x0)) AS lft, max(x0 + (least(start + length(key), pos + length(label)) - start) / CAST(length(key) AS DOUBLE) * (x1 - x0)) AS rgt, min(y0) AS top, max(y1) AS bottom, max(y1) - min(y0) AS h
  FROM s JOIN hits USING (doc, page) WHERE key <> '' AND start < pos + length(label) AND start + length(key) > pos GROUP BY doc, page, rank, field),
near AS (SELECT b.*, s.line, s.word_no, s.text, s.x0, s.y0, s.x1, s.y1, s.cy, (x1 - greatest(x0, rgt + 1)) / (x1 - x0) >= {OVERLAP} AND abs(cy - (top + bottom) / 2) <= h * {BAND} AS beside,
  (least(x1, rgt + h * 4) - greatest(x0, lft - 5)) / (x1 - x0) >= {OVERLAP} AND cy BETWEEN bottom + 1 AND bottom + h * 3 AS below, regexp_matches(text, '{SEPARATOR}') AS sep FROM boxes b JOIN s USING (doc, page)),
firsts AS (SELECT doc, page, rank, field, x0 AS fx, cy AS fy, y1 - y0 AS fh FROM near WHERE beside AND NOT sep QUALIFY row_number() OVER (PARTITION BY doc, page, rank ORDER BY x0, line, word_no) = 1),
ln AS (SELECT f.rank, f.field, s.*, row_number() OVER c AS i, lag(x1) OVER c AS before FROM firsts f JOIN s USING (doc, page) WHERE (x1 - greatest(x0, fx - 1)) / (x1 - x0) >= {OVERLAP} AND abs(cy - fy) <= fh * {BAND} WINDOW c AS (PARTITION BY doc, page, f.rank ORDER BY x0, line, word_no)),
st AS (SELECT *, sum(CASE WHEN i > 1 AND (x0 - before > {GAP} OR regexp_matches(text, '[:|]\\s*$')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page, rank ORDER BY i) AS stops FROM ln),
under AS (SELECT * FROM near WHERE below QUALIFY row_number() OVER (PARTITION BY doc, page, rank ORDER BY y0, line, word_no) = 1),
vals AS (SELECT doc, page, field, rank, i, text, x0, y0, x1, y1 FROM st WHERE stops = 0 AND i <= {MOST}
  UNION ALL SELECT doc, page, field, rank, 1, text, x0, y0, x1, y1 FROM under u WHERE NOT sep AND NOT EXISTS (SELECT 1 FROM firsts f WHERE f.doc = u.doc AND f.page = u.page AND f.rank = u.rank))
SELECT doc, page, field, string_agg(text, ' ' ORDER BY i) AS value, greatest(min(x0) - {PAD}, 0) AS x0, greatest(min(y0) - {PAD}, 0) AS y0, max(x1) + {PAD} AS x1, max(y1) + {PAD} AS y1 FROM vals GROUP BY doc, page, field, rank QUALIFY row_number() OVER (PARTITION BY doc, page, field ORDER BY rank) = 1"""

QUERIES = {"label_search": (label_search, LABEL_SEARCH)}
