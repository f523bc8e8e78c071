"""Long-form (entity, attribute, value) operators. Every first, last and n-th is by an explicit order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import BILLS, EXTRACTED, bills, extracted, table
from ..plans.utility import carried
from .ranks import ranked

FIELDS = ["click", "error", "purchase", "signup", "view"]


def first_wins(rows: DataFrame, keys: list[str], fields: list[str], order: str = "seq") -> DataFrame:
    """Wide rows: each field's first value that isn't blank. The fields are given, so no job looks for them."""
    filled = rows.filter(F.trim("value") != "")
    return filled.groupBy(*keys).pivot("field", fields).agg(F.min_by("value", order))


def occurrences(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Adds occ, the number of earlier values of the same field of the same key."""
    return rows.withColumn("occ", F.row_number().over(Window.partitionBy(*keys, "field").orderBy(order)) - 1)


def fold(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One map per key: a field's values in order, joined by ', '."""
    joined = rows.groupBy(*keys, "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))), lambda x: x["v"]), ", ").alias("value"))
    return joined.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))


def unfold(records: DataFrame) -> DataFrame:
    """Maps back to long form, without empty values; what was saved counts as certain."""
    keys = [c for c in records.columns if c != "fields"]
    return records.select(*keys, F.explode("fields").alias("field", "value")).filter("value <> ''").withColumn("confidence", F.lit("high"))


def live_wins(saved: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Saved rows of keys that aren't live, and all live rows."""
    return saved.join(live.select(*keys).distinct(), keys, "left_anti").unionByName(live)


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Merge as copy on write: rows of source replace rows with their keys and are added where there are none."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def edit(rows: DataFrame, edits: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Applies edits (keys, field, occ, new_value) to the occ-th value of a field; an edit that hits nothing adds a row."""
    marked = occurrences(rows, keys, order)
    on = [*keys, "field", "occ"]
    hit = marked.join(edits, on, "left").withColumn("edited", F.col("new_value").isNotNull()).withColumn("value", F.coalesce("new_value", "value"))
    new = edits.join(marked.select(*on), on, "left_anti").select(*on, F.col("new_value").alias("value"), F.lit(True).alias("edited"))
    return hit.select(*on, "value", "edited").unionByName(new)


def vote(rows: DataFrame, keys: list[str], exclusive: dict[str, str], default: str, order: str = "seq") -> DataFrame:
    """The document type whose exclusive fields are found most often; of equal ones the first found; default without any."""
    kind = F.create_map(*[F.lit(x) for kv in exclusive.items() for x in kv])[F.col("field")]
    counts = rows.withColumn("kind", kind).groupBy(*keys, "kind").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = F.min_by("kind", F.when(F.col("kind").isNotNull(), F.struct(-F.col("n"), F.col("first"))))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit(default)).alias("doc_type"))


def apply_merges(rows: DataFrame, merges: DataFrame, trim_values: bool = False) -> DataFrame:
    """Replaces values by (field, original, merged). Matches are exact: values with white space around them stay, unless
    trim_values."""
    value = F.trim("value") if trim_values else F.col("value")
    out = rows.withColumn("_v", value).join(merges, (F.col("_v") == F.col("original")) & (F.col("field") == F.col("merge_field")), "left")
    return out.withColumn("value", F.coalesce("merged", "value")).drop("_v", "original", "merge_field", "merged")


def panel_order(c: Column, descending: bool = False) -> list[Column]:
    """Sort keys of a typed column: blanks last in either direction, then dates, numbers and text, each by its own value."""
    blank = c.isNull() | (F.trim(c) == "")
    date = F.try_to_date(c, "MM/dd/yyyy")
    number = F.regexp_replace(c, r"[$,%\s]", "").try_cast("double")
    way = (lambda x: x.desc_nulls_last()) if descending else (lambda x: x.asc_nulls_last())
    rank = F.when(date.isNotNull(), 0).when(number.isNotNull(), 1).otherwise(2)
    return [blank.asc(), way(rank), way(date), way(number), way(F.lower(c)), way(c)]


def carry_forward(spark, sf_dir: str) -> DataFrame:
    """Providers are printed on some pages only; every page gets the last one seen in its file."""
    rows = bills(spark, sf_dir).withColumn("printed", F.when(F.col("amount") * 100 % 3 == 0, F.col("provider")))
    return rows.select("file", "page", "amount", carried(rows, "printed").alias("provider")).withColumn("amount", F.col("amount").cast("double"))


CARRY_FORWARD = f"""WITH {BILLS} SELECT file, page, CAST(amount AS DOUBLE) AS amount, last_value(CASE WHEN amount * 100 % 3 = 0 THEN provider END IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS provider FROM bills"""


def first_wins_page(spark, sf_dir: str) -> DataFrame:
    return first_wins(extracted(spark, sf_dir), ["file", "page"], FIELDS)


def first_wins_file(spark, sf_dir: str) -> DataFrame:
    return first_wins(extracted(spark, sf_dir), ["file"], FIELDS)


def _first_wins_sql(keys: str) -> str:
    cols = ", ".join(f"arg_min(value, seq) FILTER (field = '{f}') AS {f}" for f in FIELDS)
    return f"WITH {EXTRACTED} SELECT {keys}, {cols} FROM extracted WHERE trim(value) <> '' GROUP BY {keys}"


def multi_value_rows(spark, sf_dir: str) -> DataFrame:
    """The i-th sub-row of a page holds the i-th value of each field."""
    return occurrences(extracted(spark, sf_dir), ["file", "page"]).groupBy("file", "page", "occ").pivot("field", FIELDS).agg(F.min("value")).withColumnRenamed("occ", "sub")


MULTI_VALUE_ROWS = f"""WITH {EXTRACTED}, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, page, field ORDER BY seq) - 1 AS INTEGER) AS sub FROM extracted)
SELECT file, page, sub, {", ".join(f"min(value) FILTER (field = '{f}') AS {f}" for f in FIELDS)} FROM numbered GROUP BY file, page, sub"""


def doc_type_vote(spark, sf_dir: str) -> DataFrame:
    return vote(extracted(spark, sf_dir), ["file", "page"], {"click": "utility_bill", "purchase": "bank_statement", "signup": "lease"}, "utility_bill")


DOC_TYPE_VOTE = f"""WITH {EXTRACTED}, counted AS (SELECT file, page, CASE field WHEN 'click' THEN 'utility_bill' WHEN 'purchase' THEN 'bank_statement' WHEN 'signup' THEN 'lease' END AS kind, count(*) AS n, min(seq) AS first FROM extracted GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY kind IS NULL, n DESC, first) AS r FROM counted)
SELECT file, page, coalesce(kind, 'utility_bill') AS doc_type FROM ranked WHERE r = 1"""


def batch_fold(spark, sf_dir: str) -> DataFrame:
    return fold(extracted(spark, sf_dir), ["file", "page"]).select("file", "page", F.to_json("fields").alias("fields"))


BATCH_FOLD = f"""WITH {EXTRACTED}, joined AS (SELECT file, page, field, string_agg(value, ', ' ORDER BY seq) AS value FROM extracted GROUP BY ALL)
SELECT file, page, '{{' || string_agg('"' || field || '":"' || value || '"', ',' ORDER BY field) || '}}' AS fields FROM joined GROUP BY file, page"""


def batch_unpivot(spark, sf_dir: str) -> DataFrame:
    return unfold(fold(extracted(spark, sf_dir), ["file", "page"]))


BATCH_UNPIVOT = f"""WITH {EXTRACTED}, joined AS (SELECT file, page, field, string_agg(value, ', ' ORDER BY seq) AS value FROM extracted GROUP BY ALL)
SELECT file, page, field, value, 'high' AS confidence FROM joined WHERE value <> ''"""


def batch_counts(spark, sf_dir: str) -> DataFrame:
    """Batches (nations here) with the number of their records, those without any too."""
    batches = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("batch"), F.col("n_name").alias("name"))
    records = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 1 AND c_nationkey % 5 <> 0")
    return batches.join(records, F.col("batch") == F.col("c_nationkey"), "left").groupBy("batch", "name").agg(F.count("c_custkey").alias("record_count"))


BATCH_COUNTS = "SELECT n_nationkey AS batch, n_name AS name, count(c_custkey) AS record_count FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 = 1 AND c_nationkey % 5 <> 0) ON n_nationkey = c_nationkey GROUP BY 1, 2"


def list_batches(batches: DataFrame, records: DataFrame) -> DataFrame:
    """Batches (batch, created_at, ...) with the number of their records (batch, record), newest first, ties by batch: a range-partitioned sort.
    Records are counted before they meet their batch, so a batch with many is no more than one row per task."""
    counts = records.groupBy("batch").agg(F.count("record").alias("record_count"))
    return batches.join(counts, "batch", "left").fillna(0, ["record_count"]).orderBy(F.desc("created_at"), "batch")


def batch_records(records: DataFrame, batch: int) -> DataFrame:
    """A batch's records by filename and page, their fields, kept as JSON text, as a map; text that isn't JSON gives no fields."""
    return records.filter(F.col("batch") == batch).withColumn("fields", F.from_json("fields", "map<string,string>")).orderBy("filename", "page")


def batch_list(spark, sf_dir: str) -> DataFrame:
    """Customers as batches of their orders; place is a batch's among those of its nation, newest first."""
    batches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("batch"), "c_nationkey", F.expr("date_add(date'2024-01-01', cast(c_custkey * 7 % 365 as int))").alias("created_at"))
    records = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("record"))
    listed = list_batches(batches, records)
    return listed.select("batch", "record_count", F.col("created_at").cast("string").alias("created_at"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.desc("created_at"), "batch")).alias("place"))


BATCH_LIST = """WITH b AS (SELECT c_custkey AS batch, c_nationkey, DATE '2024-01-01' + CAST(c_custkey * 7 % 365 AS INTEGER) AS created_at FROM customer)
SELECT batch, count(o_orderkey) AS record_count, CAST(created_at AS VARCHAR) AS created_at, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY created_at DESC, batch) AS INTEGER) AS place
FROM b LEFT JOIN orders ON o_custkey = batch GROUP BY batch, c_nationkey, created_at"""


def batch_record_fields(spark, sf_dir: str) -> DataFrame:
    """Every order's line items as a batch's records, whose fields are kept as JSON: read back in the order of the list, with fields as a map; every tenth
    text is broken."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.concat(F.lit("f"), F.col("l_suppkey"), F.lit(".pdf")).alias("filename"), F.col("l_linenumber").cast("int").alias("page"), "l_partkey", "l_extendedprice", F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("string").alias("part"))).alias("fields"))
    li = li.withColumn("fields", F.when((F.col("batch") + F.col("page")) % 10 == 0, F.expr("left(fields, 5)")).otherwise(F.col("fields")))
    read = li.withColumn("fields", F.from_json("fields", "map<string,string>"))
    order = Window.partitionBy("batch").orderBy("filename", "page", "l_partkey", "l_extendedprice")
    return read.select("batch", "filename", "page", F.row_number().over(order).alias("place"), F.element_at("fields", F.lit("flag")).alias("flag"), F.element_at("fields", F.lit("part")).alias("part"))


BATCH_RECORD_FIELDS = """SELECT l_orderkey AS batch, 'f' || l_suppkey || '.pdf' AS filename, CAST(l_linenumber AS INTEGER) AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY 'f' || l_suppkey || '.pdf', l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS place,
  CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN l_returnflag END AS flag, CASE WHEN (l_orderkey + l_linenumber) % 10 <> 0 THEN CAST(l_partkey AS VARCHAR) END AS part FROM lineitem"""


def _records(spark, sf_dir: str, change: bool) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    rows = c.selectExpr("c_nationkey AS batch", "c_custkey AS session", "cast(c_custkey % 3 AS int) AS page", "c_name AS value")
    return rows.filter("session % 2 = 0").withColumn("value", F.concat(F.lit("new "), "value")) if change else rows.filter("session % 3 <> 0")


def batch_upsert(spark, sf_dir: str) -> DataFrame:
    return upsert(_records(spark, sf_dir, False), _records(spark, sf_dir, True), ["batch", "session", "page"])


_RECORDS = """WITH old AS (SELECT c_nationkey AS batch, c_custkey AS session, CAST(c_custkey % 3 AS INTEGER) AS page, c_name AS value FROM customer WHERE c_custkey % 3 <> 0),
new AS (SELECT c_nationkey AS batch, c_custkey AS session, CAST(c_custkey % 3 AS INTEGER) AS page, 'new ' || c_name AS value FROM customer WHERE c_custkey % 2 = 0)"""
BATCH_UPSERT = f"{_RECORDS} SELECT batch, session, page, coalesce(n.value, o.value) AS value FROM old o FULL JOIN new n USING (batch, session, page)"


def live_wins_union(spark, sf_dir: str) -> DataFrame:
    """Live pages hide the saved rows of their file and page."""
    rows = extracted(spark, sf_dir)
    return live_wins(rows.withColumn("origin", F.lit("saved")), rows.filter("file % 3 = 0 AND page < 10").withColumn("origin", F.lit("live")), ["file", "page"])


LIVE_WINS_UNION = f"WITH {EXTRACTED} SELECT seq, file, page, field, value, CASE WHEN file % 3 = 0 AND page < 10 THEN 'live' ELSE 'saved' END AS origin FROM extracted"


def edit_nth(spark, sf_dir: str) -> DataFrame:
    """The second click of every page of every fourth file is edited, and added where there is none."""
    rows = extracted(spark, sf_dir)
    edits = rows.filter("file % 4 = 0").select("file", "page").distinct().select("file", "page", F.lit("click").alias("field"), F.lit(1).alias("occ"), F.lit("edited").alias("new_value"))
    return edit(rows, edits, ["file", "page"])


EDIT_NTH = f"""WITH {EXTRACTED}, numbered AS (SELECT file, page, field, CAST(row_number() OVER (PARTITION BY file, page, field ORDER BY seq) - 1 AS INTEGER) AS occ, value FROM extracted),
edits AS (SELECT DISTINCT file, page, 'click' AS field, 1 AS occ FROM extracted WHERE file % 4 = 0)
SELECT file, page, field, occ, CASE WHEN e.file IS NOT NULL THEN 'edited' ELSE n.value END AS value, e.file IS NOT NULL AS edited
FROM numbered n FULL JOIN edits e USING (file, page, field, occ)"""
EDIT_NTH = EDIT_NTH.replace("e.file IS NOT NULL", "e.mark").replace("SELECT DISTINCT file, page, 'click' AS field, 1 AS occ", "SELECT DISTINCT file, page, 'click' AS field, 1 AS occ, true AS mark").replace("e.mark AS edited", "coalesce(e.mark, false) AS edited")


def apply_merges_query(spark, sf_dir: str) -> DataFrame:
    """Ring values become hoop ones, in names, where the text matches to the letter; every third is padded and stays."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS seq", "'name' AS field", "CASE WHEN p_partkey % 3 = 0 THEN concat(p_name, ' ') ELSE p_name END AS value")
    merges = table(spark, sf_dir, "part").filter(F.col("p_name").endswith("ring")).select(F.lit("name").alias("merge_field"), F.col("p_name").alias("original"), F.regexp_replace("p_name", "ring$", "hoop").alias("merged")).distinct()
    return apply_merges(rows, merges)


APPLY_MERGES = "SELECT p_partkey AS seq, 'name' AS field, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' ' ELSE regexp_replace(p_name, 'ring$', 'hoop') END AS value FROM part"


def panel_sort(spark, sf_dir: str) -> DataFrame:
    """Place of each row in the panel, within its market segment, by a mixed column; sorting is stable by the key."""
    c = table(spark, sf_dir, "customer").withColumn("shown", F.expr("CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN date_format(date_add(date'2024-01-31', cast(c_custkey % 400 AS int)), 'MM/dd/yyyy') WHEN 2 THEN concat('$', cast(cast(c_custkey % 97 AS int) AS string)) WHEN 3 THEN c_name END"))
    up = ranked(c.select("c_custkey", "c_mktsegment", "shown"), ["c_mktsegment"], [*panel_order(F.col("shown")), F.asc("c_custkey")], "up")
    return ranked(up, ["c_mktsegment"], [*panel_order(F.col("shown"), True), F.asc("c_custkey")], "down").drop("shown")


PANEL_SORT = """WITH c AS (SELECT *, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN strftime(DATE '2024-01-31' + CAST(c_custkey % 400 AS INTEGER), '%m/%d/%Y') WHEN 2 THEN '$' || (c_custkey % 97) WHEN 3 THEN c_name END AS shown FROM customer),
k AS (SELECT *, shown IS NULL OR trim(shown) = '' AS blank, CASE WHEN c_custkey % 5 = 1 THEN 0 WHEN c_custkey % 5 = 2 THEN 1 ELSE 2 END AS rank, CASE WHEN c_custkey % 5 = 1 THEN strptime(shown, '%m/%d/%Y') END AS d, CASE WHEN c_custkey % 5 = 2 THEN CAST(c_custkey % 97 AS DOUBLE) END AS n FROM c)
SELECT c_custkey, c_mktsegment, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY blank, rank ASC NULLS LAST, d ASC NULLS LAST, n ASC NULLS LAST, lower(shown) ASC NULLS LAST, shown ASC NULLS LAST, c_custkey) AS INTEGER) AS up,
  CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY blank, rank DESC NULLS LAST, d DESC NULLS LAST, n DESC NULLS LAST, lower(shown) DESC NULLS LAST, shown DESC NULLS LAST, c_custkey) AS INTEGER) AS down FROM k"""


def pdf_credit_debit(spark, sf_dir: str) -> DataFrame:
    """Per file: signed sums and counts of credits and debits."""
    o = table(spark, sf_dir, "orders")
    credit, amount = F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)") * F.when(F.col("o_orderkey") % 10 == 0, -1).otherwise(1)
    return o.groupBy(F.col("o_custkey").alias("file")).agg(
        F.coalesce(F.sum(F.when(credit, amount)), F.lit(0)).cast("double").alias("credits"), F.coalesce(F.sum(F.when(~credit, amount)), F.lit(0)).cast("double").alias("debits"),
        F.count_if(credit).alias("n_credits"), F.count_if(~credit).alias("n_debits"),
    )


PDF_CREDIT_DEBIT = """WITH o AS (SELECT o_custkey, o_orderstatus = 'F' AS c, CAST(o_totalprice AS DECIMAL(18,2)) * CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE 1 END AS a FROM orders)
SELECT o_custkey AS file, CAST(coalesce(sum(a) FILTER (c), 0) AS DOUBLE) AS credits, CAST(coalesce(sum(a) FILTER (NOT c), 0) AS DOUBLE) AS debits, count(*) FILTER (c) AS n_credits, count(*) FILTER (NOT c) AS n_debits FROM o GROUP BY 1"""


def field_first_seen(spark, sf_dir: str) -> DataFrame:
    """The union of a file's fields, in the order first seen."""
    seen = extracted(spark, sf_dir).groupBy("file", "field").agg(F.min("seq").alias("first"))
    return seen.select("file", "field", F.row_number().over(Window.partitionBy("file").orderBy("first")).alias("place"))


FIELD_FIRST_SEEN = f"WITH {EXTRACTED} SELECT file, field, CAST(row_number() OVER (PARTITION BY file ORDER BY min(seq)) AS INTEGER) AS place FROM extracted GROUP BY file, field"


def pages_extracted(spark, sf_dir: str) -> DataFrame:
    return extracted(spark, sf_dir).filter("value <> ''").groupBy("file").agg(F.countDistinct("page").alias("pages"), F.countDistinct("field").alias("fields"))


PAGES_EXTRACTED = f"WITH {EXTRACTED} SELECT file, count(DISTINCT page) AS pages, count(DISTINCT field) AS fields FROM extracted WHERE value <> '' GROUP BY file"


def lease_terms(spark, sf_dir: str) -> DataFrame:
    """Term in years and value of a lease that starts at an order's date and ends so many days later; 0 where a date is missing."""
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS lease", "CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_orderdate AS date) END AS starts", "date_add(cast(o_orderdate AS date), cast(o_orderkey % 3650 AS int)) AS ends", "cast(cast(o_totalprice AS int) AS double) AS rent")
    term = F.coalesce(F.date_diff("ends", "starts") / F.lit(365.25), F.lit(0.0))
    return o.select("lease", F.round(term, 6).alias("term_years"), F.round(F.col("rent") * term * 12, 2).alias("lease_value"))


LEASE_TERMS = """WITH o AS (SELECT o_orderkey AS lease, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderkey % 3650 AS DOUBLE) END AS days, CAST(trunc(o_totalprice) AS DOUBLE) AS rent FROM orders)
SELECT lease, round(coalesce(days / 365.25::DOUBLE, 0), 6) AS term_years, round(rent * coalesce(days / 365.25::DOUBLE, 0) * 12, 2) AS lease_value FROM o"""

QUERIES = {
    "carry_forward": (carry_forward, CARRY_FORWARD),
    "first_wins_page": (first_wins_page, _first_wins_sql("file, page")),
    "first_wins_file": (first_wins_file, _first_wins_sql("file")),
    "multi_value_rows": (multi_value_rows, MULTI_VALUE_ROWS),
    "doc_type_vote": (doc_type_vote, DOC_TYPE_VOTE),
    "batch_fold": (batch_fold, BATCH_FOLD),
    "batch_unpivot": (batch_unpivot, BATCH_UNPIVOT),
    "batch_counts": (batch_counts, BATCH_COUNTS),
    "batch_list": (batch_list, BATCH_LIST),
    "batch_record_fields": (batch_record_fields, BATCH_RECORD_FIELDS),
    "batch_upsert": (batch_upsert, BATCH_UPSERT),
    "live_wins_union": (live_wins_union, LIVE_WINS_UNION),
    "edit_nth": (edit_nth, EDIT_NTH),
    "apply_merges": (apply_merges_query, APPLY_MERGES),
    "panel_sort": (panel_sort, PANEL_SORT),
    "pdf_credit_debit": (pdf_credit_debit, PDF_CREDIT_DEBIT),
    "field_first_seen": (field_first_seen, FIELD_FIRST_SEEN),
    "pages_extracted": (pages_extracted, PAGES_EXTRACTED),
    "lease_terms": (lease_terms, LEASE_TERMS),
}
