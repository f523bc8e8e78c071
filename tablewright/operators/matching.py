"""Headers to labels, labels to values, templates to pages."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.layout import BENCHMARK_WORDS, DOCUMENT_WORDS, benchmark_words, document_words
from ..sources.tables import table
from .anchors import Keys

PAGE = ["doc", "page"]


def runs(words: DataFrame, longest: int = 4) -> DataFrame:
    """Runs of 1 to `longest` neighbouring words of a line, with their text and box."""
    w = Window.partitionBy("doc", "page", "line").orderBy("word_no")
    out = None
    for k in range(1, longest + 1):
        ahead = lambda c, i: F.lead(c, i).over(w) if i else F.col(c)
        texts = [ahead("text", i) for i in range(k)]
        part = words.select("doc", "page", "line", "word_no", F.lit(k).alias("span"), F.concat(*[x for t in texts for x in (t, F.lit(" "))][:-1]).alias("text"), "x0", "y0", ahead("x1", k - 1).alias("x1"), "y1").filter(F.col("text").isNotNull())
        out = part if out is None else out.unionAll(part)
    return out


def match_headers(headers: DataFrame, words: DataFrame, top: int = 4) -> DataFrame:
    """Each page's best labels for a header (header_id, header): shared tokens over the larger token set, at least 0.5 for one
    word, 0.7 for runs of words, which get a bonus of 0.05 (so a score may be 1.05). Header and label meet through the
    tokens they share; there's no product of the two."""
    h = headers.select("header_id", F.array_distinct(tokens(F.col("header"))).alias("ht"))
    r = runs(words).withColumn("rt", F.array_distinct(tokens(F.col("text")))).filter(F.size("rt") > 0)
    met = r.select("*", F.explode("rt").alias("token")).join(h.select("header_id", "ht", F.explode("ht").alias("token")), "token")
    keys = ["header_id", "doc", "page", "line", "word_no", "span", "text", "x0", "y0", "x1"]
    scored = met.groupBy(*keys, F.size("rt").alias("nr"), F.size("ht").alias("nh")).agg(F.count("*").alias("shared")).withColumn("score", F.col("shared") / F.greatest("nr", "nh"))
    good = scored.filter(F.col("score") >= F.when(F.col("span") == 1, 0.5).otherwise(0.7)).withColumn("score", F.col("score") + F.when(F.col("span") > 1, 0.05).otherwise(0.0))
    best = Window.partitionBy("header_id", "doc", "page").orderBy(F.desc("score"), "span", "line", "word_no")
    return good.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top).select(*keys, "score", "place")


def _headers(spark, sf_dir: str) -> DataFrame:
    """The first three words of every benchmark item."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("header_id"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("header"))


def header_similarity(spark, sf_dir: str) -> DataFrame:
    out = match_headers(_headers(spark, sf_dir), benchmark_words(spark, sf_dir))
    return out.select("header_id", "doc", "page", "line", "word_no", "span", F.round("score", 6).alias("score"), "place")


HEADER_SIMILARITY = f"""WITH {BENCHMARK_WORDS},
r AS (SELECT *, unnest([1, 2, 3, 4]) AS span FROM words),
t AS (SELECT r.doc, r.page, r.line, r.word_no, r.span, string_agg(w.text, ' ' ORDER BY w.word_no) AS text FROM r JOIN (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY word_no) AS k FROM words) w ON w.doc = r.doc AND w.line = r.line
  JOIN (SELECT doc, line, word_no, row_number() OVER (PARTITION BY doc, line ORDER BY word_no) AS k FROM words) s ON s.doc = r.doc AND s.line = r.line AND s.word_no = r.word_no AND w.k BETWEEN s.k AND s.k + r.span - 1
  GROUP BY ALL HAVING count(*) = r.span),
k AS (SELECT *, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2)) AS rt FROM t),
h AS (SELECT item_id AS header_id, list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:3], ' ')), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: length(x) >= 2)) AS ht FROM benchmark),
s AS (SELECT header_id, doc, page, line, word_no, span, len(list_intersect(rt, ht)) / greatest(len(rt), len(ht))::DOUBLE AS score FROM k, h WHERE len(list_intersect(rt, ht)) > 0),
g AS (SELECT header_id, doc, page, line, word_no, span, score + CASE WHEN span > 1 THEN 0.05::DOUBLE ELSE 0 END AS score FROM s WHERE score >= CASE WHEN span = 1 THEN 0.5 ELSE 0.7 END)
SELECT header_id, doc, page, line, word_no, span, round(score, 6) AS score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY header_id, doc, page ORDER BY score DESC, span, line, word_no) AS INTEGER) AS place FROM g) WHERE place <= 4"""


def label_values(labels: DataFrame, words: DataFrame) -> DataFrame:
    """The value that belongs to each label (label_id and a word's columns): the text after a separator within it; else the
    next word on its line, passing over a lone separator; else the first word of the line below that overlaps it."""
    lab = labels.select("label_id", *[F.col(c).alias(f"l_{c}") for c in ("doc", "page", "line", "text", "x0", "y0", "x1", "y1")])
    tail = F.trim(F.regexp_extract("l_text", r"[:\-–—](.*)$", 1))
    inline = lab.filter(tail != "").select("label_id", tail.alias("value"), F.lit("inline").alias("how"))
    rest = lab.filter(tail == "")
    on = (F.col("doc") == F.col("l_doc")) & (F.col("page") == F.col("l_page"))
    width = F.col("l_x1") - F.col("l_x0")
    height = F.col("l_y1") - F.col("l_y0")
    same = F.abs((F.col("y0") + F.col("y1")) / 2 - (F.col("l_y0") + F.col("l_y1")) / 2) <= F.greatest(height, F.col("y1") - F.col("y0")) * 0.6
    right = same & (F.col("x0") > F.col("l_x0") + width * 0.4)
    gap = F.col("y0") - F.col("l_y1")
    below = (gap >= -2) & (gap <= height * 2.2) & (F.col("x0") < F.col("l_x0") + width * 1.2) & (F.col("x1") > F.col("l_x0") - 20) & ~same
    met = rest.join(words, on & F.col("line").between(F.col("l_line") - 1, F.col("l_line") + 3)).filter(right | below)
    cand = F.struct(F.when(right, 0).otherwise(1).alias("how"), F.when(right, F.lit(0.0)).otherwise(F.col("y0")).alias("y"), F.col("x0").alias("x"), F.col("text").alias("text"))
    firsts = met.groupBy("label_id").agg(F.slice(F.array_sort(F.collect_list(cand)), 1, 2).alias("c"))
    one, two = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    lone = one["text"].rlike(r"^[:\-–—|]+$") & (one["how"] == 0) & (two["how"] == 0)
    pick = F.when(F.coalesce(lone, F.lit(False)), two).otherwise(one)
    return inline.unionAll(firsts.select("label_id", pick["text"].alias("value"), F.when(pick["how"] == 0, "right").otherwise("below").alias("how")))


def label_value(spark, sf_dir: str) -> DataFrame:
    """Every word of the benchmark that ends a sentence is a label."""
    w = benchmark_words(spark, sf_dir)
    labels = w.filter(F.col("text").endswith(".")).withColumn("label_id", F.concat_ws(":", "doc", "line", "word_no"))
    return label_values(labels, w)


LABEL_VALUE = f"""WITH {BENCHMARK_WORDS}, lab AS (SELECT doc || ':' || line || ':' || word_no AS label_id, * FROM words WHERE text LIKE '%.'),
met AS (SELECT lab.label_id, w.text, CASE WHEN abs(w.y0 + w.y1 - lab.y0 - lab.y1) / 2 <= 6 AND w.x0 > lab.x0 + (lab.x1 - lab.x0) * 0.4 THEN 0 ELSE 1 END AS how, w.y0, w.x0,
    CASE WHEN w.line = lab.line THEN w.x0 > lab.x0 + (lab.x1 - lab.x0) * 0.4 ELSE w.y0 - lab.y1 BETWEEN -2 AND 22 AND w.x0 < lab.x0 + (lab.x1 - lab.x0) * 1.2 AND w.x1 > lab.x0 - 20 END AS ok
  FROM lab JOIN words w ON w.doc = lab.doc AND w.page = lab.page AND w.line BETWEEN lab.line - 1 AND lab.line + 3)
SELECT label_id, text AS value, CASE how WHEN 0 THEN 'right' ELSE 'below' END AS how FROM (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY how, CASE WHEN how = 0 THEN 0 ELSE y0 END, x0) AS r FROM met WHERE ok) WHERE r = 1"""


def place_anchored(pairs: DataFrame, hits: DataFrame) -> DataFrame:
    """Where a pair's value lies on a page: the key's nearest hit on the page (by squared distance to where the key was) plus the offset of
    value from key, clamped to the page. Keys are single words; a page without a hit has no row (anchors.anchor_values is for keys of several words,
    and for places on every page)."""
    p = pairs.select("pair", "key", "kx", "ky", "vx", "vy")
    near = p.join(hits.withColumnRenamed("text", "key"), "key").withColumn("d", (F.col("x0") - F.col("kx")) * (F.col("x0") - F.col("kx")) + (F.col("y0") - F.col("ky")) * (F.col("y0") - F.col("ky")))
    best = near.groupBy("pair", "doc", "page").agg(F.min_by(F.struct("x0", "y0", "kx", "ky", "vx", "vy"), F.struct("d", "y0", "x0")).alias("b"))
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(most))
    return best.select("pair", "doc", "page", clamp(F.col("b.x0") + F.col("b.vx") - F.col("b.kx"), 612.0).alias("x"), clamp(F.col("b.y0") + F.col("b.vy") - F.col("b.ky"), 792.0).alias("y"))


def anchor_place(spark, sf_dir: str) -> DataFrame:
    """Pairs are the first two words of every item; the pages are all items'."""
    w = benchmark_words(spark, sf_dir)
    first = w.filter("line = 0 AND word_no < 2").groupBy(F.col("doc").alias("pair")).agg(F.min_by("text", "word_no").alias("key"), F.min_by("x0", "word_no").alias("kx"), F.min_by("y0", "word_no").alias("ky"), F.max_by("x0", "word_no").alias("vx"), F.max_by("y0", "word_no").alias("vy"))
    return place_anchored(first, w.select("doc", "page", "text", "x0", "y0"))


ANCHOR_PLACE = f"""WITH {BENCHMARK_WORDS}, p AS (SELECT doc AS pair, arg_min(text, word_no) AS key, arg_min(x0, word_no) AS kx, arg_min(y0, word_no) AS ky, arg_max(x0, word_no) AS vx, arg_max(y0, word_no) AS vy FROM words WHERE line = 0 AND word_no < 2 GROUP BY doc),
n AS (SELECT pair, w.doc, w.page, w.x0 + vx - kx AS x, w.y0 + vy - ky AS y, row_number() OVER (PARTITION BY pair, w.doc, w.page ORDER BY (w.x0 - kx) * (w.x0 - kx) + (w.y0 - ky) * (w.y0 - ky), w.y0, w.x0) AS r FROM p JOIN words w ON w.text = p.key)
SELECT pair, doc, page, least(greatest(x, 0), 612) AS x, least(greatest(y, 0), 792) AS y FROM n WHERE r = 1"""


def find_text(texts: DataFrame, queries: list[str], id_col: str = "doc", text_col: str = "text") -> DataFrame:
    """Every non-overlapping hit of each query in each text, whatever the case and the white space: (id, query, hit, start,
    end) in characters of the text. All queries are looked for in one pass over the text's words, in lower case with single spaces."""
    kind = texts.select(id_col).schema[0].dataType.simpleString()
    wanted = [" ".join(q.lower().split()) for q in queries]

    def places(word: str) -> range | list[int]:
        """Where each character of the lower-cased word comes from; lower case may be longer."""
        return range(len(word)) if len(word.lower()) == len(word) else [i for i, c in enumerate(word) for _ in c.lower()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys(wanted)
        for b in batches:
            rows, cols = [], ([], [], [], [])
            for i, text in enumerate(b.column(1)):
                words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text.as_py() or "")]
                low = [w.lower() for _, w in words]
                starts = [0, *accumulate(len(w) + 1 for w in low)]
                n = [0] * len(wanted)
                for k, start, end in keys.hits(" ".join(low)):
                    first, last = bisect_right(starts, start) - 1, bisect_right(starts, end - 1) - 1
                    at, to = words[first][0] + places(words[first][1])[start - starts[first]], words[last][0] + places(words[last][1])[end - 1 - starts[last]] + 1
                    rows.append(i)
                    for c, v in zip(cols, (wanted[k], n[k], at, to), strict=True):
                        c.append(v)
                    n[k] += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]], ["_id", "query", "hit", "start", "end"])

    return texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(scan, f"_id {kind}, query string, hit int, start int, end int").withColumnRenamed("_id", id_col)


def text_positions(spark, sf_dir: str) -> DataFrame:
    return find_text(table(spark, sf_dir, "documents"), ["License", "the  and", "AKIA", "de la"], "doc_id")


TEXT_POSITIONS = r"""WITH q(query, pattern) AS (VALUES ('license', 'license'), ('the and', 'the\s+and'), ('akia', 'akia'), ('de la', 'de\s+la')),
m AS (SELECT doc_id, query, regexp_split_to_array(lower(text), pattern) AS parts, regexp_extract_all(lower(text), pattern) AS hits FROM documents, q WHERE regexp_matches(lower(text), pattern)),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM m),
s AS (SELECT *, list_sum(list_transform(parts[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS first_at FROM e)
SELECT doc_id, query, CAST(k - 1 AS INTEGER) AS hit, CAST(first_at AS INTEGER) AS start, CAST(first_at + length(hits[k]) AS INTEGER) AS "end" FROM s"""


def apply_template(marks: DataFrame, pages: DataFrame, first_target: int) -> DataFrame:
    """Marks (mark, page, x, y) copied to other documents, shifted so that the first marked page becomes first_target; pages
    that a document lacks get none."""
    first = marks.agg(F.min("page").alias("first"))  # one row
    shifted = marks.join(F.broadcast(first)).withColumn("page", (F.col("page") - F.col("first") + first_target).cast("int")).drop("first")
    return pages.join(shifted, "page").select("doc", "mark", "page", "x", "y")


def template_apply(spark, sf_dir: str) -> DataFrame:
    """The marks of 12 places on pages 1 to 3, applied to all documents from their second page."""
    marks = spark.range(12).selectExpr("id AS mark", "cast(id % 3 + 1 AS int) AS page", "cast(id * 5 AS double) AS x", "cast(id * 7 AS double) AS y")
    pages = document_words(spark, sf_dir).select("doc", "page").distinct()
    return apply_template(marks, pages, 2)


TEMPLATE_APPLY = f"""WITH {DOCUMENT_WORDS}, m AS (SELECT range AS mark, CAST(range % 3 + 2 AS INTEGER) AS page, CAST(range * 5 AS DOUBLE) AS x, CAST(range * 7 AS DOUBLE) AS y FROM range(12))
SELECT doc, mark, page, x, y FROM (SELECT DISTINCT doc, page FROM words) JOIN m USING (page)"""


def lookup_rows(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The first row of a sheet with a cell equal to the wanted key, trimmed and whatever the case; null where there's none."""
    norm = lambda c: F.lower(F.trim(c))
    rows = cells.groupBy(norm("cell").alias("k")).agg(F.min("row").alias("row"))
    return wanted.withColumn("k", norm("key")).join(rows, "k", "left").drop("k")


def row_key_lookup(spark, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").selectExpr("p_partkey AS row", "explode(array(p_name, p_brand)) AS cell")
    wanted = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS id", "CASE WHEN n_nationkey % 2 = 0 THEN concat(' BRAND#', cast(n_nationkey AS string), ' ') ELSE n_name END AS key")
    return lookup_rows(cells, wanted)


ROW_KEY_LOOKUP = """WITH c AS (SELECT p_partkey AS row, unnest([p_name, p_brand]) AS cell FROM part), n AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN ' BRAND#' || n_nationkey || ' ' ELSE n_name END AS key FROM nation)
SELECT id, key, min(row) AS row FROM n LEFT JOIN c ON lower(trim(cell)) = lower(trim(key)) GROUP BY id, key"""

QUERIES = {
    "header_similarity": (header_similarity, HEADER_SIMILARITY),
    "label_value": (label_value, LABEL_VALUE),
    "anchor_place": (anchor_place, ANCHOR_PLACE),
    "text_positions": (text_positions, TEXT_POSITIONS),
    "template_apply": (template_apply, TEMPLATE_APPLY),
    "row_key_lookup": (row_key_lookup, ROW_KEY_LOOKUP),
}
