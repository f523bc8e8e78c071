"""Queries over what sheets, clipboards and searches are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_basic, search_key
from ..sources.layout import BENCHMARK_WORDS, benchmark_words
from ..sources.tables import USAGE, table, usage
from ..sources.xlsx import as_html, as_html_spans, as_tsv, looks_like_header
from ..streaming.usage_stream import usage_windows
from .extraction import first_match
from .matching import runs
from .page_folds import expand_spans


def text_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of up to four words of every benchmark line, as boxes a point wide and high at least."""
    r = runs(benchmark_words(spark, sf_dir))
    return r.select("doc", "line", "word_no", "span", "text", "x0", F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")).alias("width"), F.greatest(F.lit(1.0), F.col("y1") - F.col("y0")).alias("height"))


TEXT_RUNS = f"""WITH {BENCHMARK_WORDS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc, line ORDER BY word_no) AS i FROM words), r AS (SELECT *, unnest([1, 2, 3, 4]) AS span FROM k)
SELECT r.doc, r.line, r.word_no, r.span, string_agg(w.text, ' ' ORDER BY w.i) AS text, r.x0, greatest(1.0::DOUBLE, max(w.x1) - r.x0) AS width, greatest(1.0::DOUBLE, r.y1 - r.y0) AS height
FROM r JOIN k w ON w.doc = r.doc AND w.line = r.line AND w.i BETWEEN r.i AND r.i + r.span - 1 GROUP BY r.doc, r.line, r.word_no, r.i, r.span, r.x0, r.y0, r.y1 HAVING count(*) = r.span"""


def header_heuristic(spark, sf_dir: str) -> DataFrame:
    """Whether each order's table begins with a header: for every third its first row is of words, for others of numbers, dashes and blanks."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n_rows"), F.min("l_extendedprice").alias("price"))
    k = F.col("l_orderkey") % 3
    first = F.when(k == 0, F.array(F.lit("Qty"), F.lit("Price"))).when(k == 1, F.array(F.lit(" "), F.col("price").cast("decimal(18,2)").cast("string"))).otherwise(F.array(F.lit("1-2"), F.lit("--")))
    return li.select("l_orderkey", "n_rows", looks_like_header(first, F.col("n_rows")).alias("is_header"))


HEADER_HEURISTIC = "SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n_rows, count(*) > 1 AND l_orderkey % 3 <> 1 AS is_header FROM lineitem GROUP BY l_orderkey"


def clipboard(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a row of two cells; every third turn's text spans two columns."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(" <a&b>\tend")))
    cells = F.array("role", "text")
    spans = F.array(F.struct(F.col("role").alias("text"), F.lit(1).alias("rowspan"), F.lit(1).alias("colspan")), F.struct(F.col("text").alias("text"), F.lit(1).alias("rowspan"), F.when(F.col("turn") % 3 == 0, 2).otherwise(1).alias("colspan")))
    return c.select("conv_id", "turn", as_tsv(cells).alias("tsv"), as_html(cells).alias("html"), as_html_spans(spans).alias("spanned"))


CLIPBOARD = r"""WITH c AS (SELECT conv_id, turn, role, text || ' <a&b>' || chr(9) || 'end' AS text FROM conversations), s AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM c)
SELECT conv_id, turn, role || chr(9) || regexp_replace(text, '[\t\r\n]+', ' ', 'g') AS tsv, '<tr><td>' || role || '</td><td>' || safe || '</td></tr>' AS html,
  '<tr><td>' || role || '</td><td' || CASE WHEN turn % 3 = 0 THEN ' colspan="2"' ELSE '' END || '>' || safe || '</td></tr>' AS spanned FROM s"""


def search_keys(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's text, as it is searched and as it is compared."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(search_key(F.col("text"))).alias("search"), F.md5(normalise_basic(F.col("text"))).alias("basic"))


SEARCH_KEYS = r"""SELECT doc_id, md5(trim(trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g')), '.,:;!?()[]{}"''')) AS search, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS basic FROM documents"""

PATTERNS = (r"Licensed under ([A-Z]{2} [A-Z-]+)", r"AKIA([A-Z0-9]{4})", r"([0-9]{3}-[0-9]{3,4})", r"^(\S+)")


def pattern_pack(spark, sf_dir: str) -> DataFrame:
    """What the first of several patterns that a document has says, and how sure that is."""
    value, confidence = first_match(F.col("text"), list(PATTERNS))
    return table(spark, sf_dir, "documents").select("doc_id", value.alias("value"), confidence.alias("confidence"))


_PACK = [f"nullif(trim(regexp_extract(text, '{p}', 1)), '')" for p in PATTERNS]
PATTERN_PACK = f"SELECT doc_id, coalesce({', '.join(_PACK)}) AS value, CASE WHEN coalesce({', '.join(_PACK[:2])}) IS NOT NULL THEN 'high' WHEN coalesce({', '.join(_PACK)}) IS NOT NULL THEN 'medium' END AS confidence FROM documents"


def span_slots(spark, sf_dir: str) -> DataFrame:
    """Line items as cells of up to three rows and two columns, each with its slots."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("page"), (F.col("l_linenumber") * 3).cast("int").alias("row"), (F.col("l_suppkey") % 50).cast("int").alias("col"), (F.col("l_partkey") % 3 + 1).cast("int").alias("rowspan"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("colspan"), F.concat(F.lit("p"), F.col("l_partkey")).alias("text"))
    return expand_spans(c)


SPAN_SLOTS = """WITH c AS (SELECT l_orderkey AS doc, l_partkey AS page, CAST(l_linenumber * 3 AS INTEGER) AS r0, CAST(l_suppkey % 50 AS INTEGER) AS c0, l_partkey % 3 + 1 AS n, l_suppkey % 2 + 1 AS m FROM lineitem),
r AS (SELECT *, CAST(unnest(range(r0, r0 + n)) AS INTEGER) AS row FROM c), s AS (SELECT *, CAST(unnest(range(c0, c0 + m)) AS INTEGER) AS col FROM r)
SELECT doc, page, row, col, CASE WHEN row = r0 AND col = c0 THEN 'p' || page ELSE '' END AS text FROM s"""


def usage_by_hour(spark, sf_dir: str) -> DataFrame:
    """The stream's windows, over the table."""
    out = usage_windows(usage(spark, sf_dir).select("used_at", "kind", "amount"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "kind", "n", "amount")


USAGE_BY_HOUR = f"WITH {USAGE} SELECT strftime(date_trunc('hour', used_at), '%Y-%m-%d %H') AS hour, kind, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM usage GROUP BY 1, 2"

QUERIES = {
    "text_runs": (text_runs, TEXT_RUNS),
    "header_heuristic": (header_heuristic, HEADER_HEURISTIC),
    "clipboard": (clipboard, CLIPBOARD),
    "search_keys": (search_keys, SEARCH_KEYS),
    "pattern_pack": (pattern_pack, PATTERN_PACK),
    "span_slots": (span_slots, SPAN_SLOTS),
    "usage_by_hour": (usage_by_hour, USAGE_BY_HOUR),
}
