"""Extracted fields by kind: cleaning, dates, guards, deletion, labels, spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import normalise_amount, normalise_percent, normalise_year
from ..functions.dates import extract_date, normalise_date
from ..functions.text import let, sanitise
from ..sources.tables import EXTRACTED, extracted, table

# The fields of each kind. No field is a percent.
DATE_FIELDS = ("billing_date", "statement_date", "appraised_date", "lease_date", "lease_begin_date", "lease_end_date", "tax_bill_date", "tax_due_date")
AMOUNT_FIELDS = (
    "total_gas_bill", "total_electricity_bill", "total_internet_bill", "total_phone_bill", "total_water_bill", "total_sewer_bill", "total_water_sewer_bill", "total_trash_bill", "total_utilities",
    "beginning_balance", "ending_balance", "total_credits", "total_debits", "appraised_as_is_value", "security_deposit", "rent_and_charges", "monthly_rent", "onetime_concession_amount",
    "monthly_discount", "other_discount", "total_income_ca", "total_income_non_ca", "total_rent", "utility_allowance", "ca_shelter_allowance", "cityfheps_rent_supplement", "household_share",
    "utility_payment", "total_monthly_rent", "total_tax_due", "assessed_value",
)
PERCENT_FIELDS: tuple[str, ...] = ()
YEAR_FIELDS = ("tax_year",)
#: Fields whose dates are read where they are extracted, before any other cleaning.
EARLY_DATE_FIELDS = ("billing_date", "statement_date", "appraised_date", "lease_date", "lease_begin_date", "lease_end_date")
#: The date field whose ranges count by their end.
END_FIELD = "billing_date"


def clean_value(field: Column, value: Column) -> Column:
    """The value cleaned, then normalised by its field's kind; null if nothing is left of it. A rate keeps its digits, also if all are 0 and 1, which
    the reference takes for a hidden number."""

    def by_kind(v: Column) -> Column:
        out = F.when(field == END_FIELD, normalise_date(v, take_end=True)).when(field.isin(*DATE_FIELDS), normalise_date(v)).when(field.isin(*AMOUNT_FIELDS), normalise_amount(v)).when(field.isin(*YEAR_FIELDS), normalise_year(v))
        return (out.when(field.isin(*PERCENT_FIELDS), normalise_percent(v)) if PERCENT_FIELDS else out).otherwise(v)

    return let(sanitise(value, keep_fractions=True), by_kind)


def early_date(field: Column, value: Column) -> Column:
    """A date field's value as MM/DD/YYYY, of billing dates the end of a range; what isn't a date, and other fields, as they are."""
    found = F.when(field == END_FIELD, extract_date(value, take_end=True)).otherwise(extract_date(value))
    return F.when(field.isin(*EARLY_DATE_FIELDS) & (found != "NONE"), found).otherwise(value)


def printed_fields(spark, sf_dir: str) -> DataFrame:
    """Every order as one extracted field, printed as documents print it: seq, field, value."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_totalprice").cast("decimal(18,2)").alias("p"))
    k, f = F.col("o_orderkey") % 8, F.date_format
    span = F.concat(f("d", "MM/dd/yyyy"), F.lit(" - "), f(F.date_add("d", 30), "MM/dd/yyyy"))
    cases = [
        ("billing_date", span), ("lease_date", span), ("total_gas_bill", F.concat(F.lit("[sig|req|x] $"), F.format_number("p", 2))), ("tax_year", F.concat(F.lit("Tax year "), f("d", "yyyy"), F.lit(" (est)"))),
        ("cap_rate", F.concat(F.lit("0.0"), F.col("o_orderkey").cast("string"))), ("remarks", F.concat(F.lit("  see   order "), F.col("o_orderkey").cast("string"))), ("remarks", F.lit("[sig|req|x]")), ("tax_due_date", F.lit("on receipt")),
    ]
    field, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, v) in enumerate(cases):
        field, value = F.when(k == i, F.lit(name)).otherwise(field), F.when(k == i, v).otherwise(value)
    return o.select(F.col("o_orderkey").alias("seq"), field.alias("field"), value.alias("value"))


def field_clean(spark, sf_dir: str) -> DataFrame:
    return printed_fields(spark, sf_dir).select("seq", "field", clean_value(F.col("field"), F.col("value")).alias("value"))


_FIELD = "CASE o_orderkey % 8 WHEN 0 THEN 'billing_date' WHEN 1 THEN 'lease_date' WHEN 2 THEN 'total_gas_bill' WHEN 3 THEN 'tax_year' WHEN 4 THEN 'cap_rate' WHEN 5 THEN 'remarks' WHEN 6 THEN 'remarks' ELSE 'tax_due_date' END AS field"
_SPAN = "strftime(o_orderdate, '%m/%d/%Y') || ' - ' || strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y')"
_RATE = "'0.0' || CAST(o_orderkey AS VARCHAR)"
_HALVED = f"CASE WHEN length({_RATE}) % 2 = 0 AND left({_RATE}, length({_RATE}) // 2) = right({_RATE}, length({_RATE}) // 2) THEN left({_RATE}, length({_RATE}) // 2) ELSE {_RATE} END"
FIELD_CLEAN = f"""SELECT o_orderkey AS seq, {_FIELD}, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 2 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 3 THEN strftime(o_orderdate, '%Y') WHEN 4 THEN {_HALVED} WHEN 5 THEN 'see order ' || o_orderkey WHEN 6 THEN NULL ELSE 'on receipt' END AS value FROM orders"""


def field_dates(spark, sf_dir: str) -> DataFrame:
    return printed_fields(spark, sf_dir).select("seq", "field", early_date(F.col("field"), F.col("value")).alias("value"))


FIELD_DATES = f"""SELECT o_orderkey AS seq, {_FIELD}, CASE o_orderkey % 8 WHEN 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%m/%d/%Y') WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y')
  WHEN 2 THEN '[sig|req|x] $' || format('{{:,}}', CAST(trunc(CAST(o_totalprice AS DECIMAL(18,2))) AS BIGINT)) || right(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 3)
  WHEN 3 THEN 'Tax year ' || strftime(o_orderdate, '%Y') || ' (est)' WHEN 4 THEN {_RATE} WHEN 5 THEN '  see   order ' || o_orderkey WHEN 6 THEN '[sig|req|x]' ELSE 'on receipt' END AS value FROM orders"""


def within_document(rows: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Rows (key, page, value, confidence) with null and low for pages that the document (key, pages) doesn't have."""
    there = F.coalesce((F.col("page") >= 1) & (F.col("page") <= F.col("pages")), F.lit(False))
    guarded = rows.join(documents, key, "left")
    return guarded.withColumns({"value": F.when(there, F.col("value")), "confidence": F.when(there, F.col("confidence")).otherwise("low")}).drop("pages")


def page_bounds(spark, sf_dir: str) -> DataFrame:
    """Fields of users' days, of documents that have up to 20 pages, some none."""
    rows = extracted(spark, sf_dir).withColumn("confidence", F.lit("high"))
    users = rows.select("file").distinct().filter(F.col("file") % 11 != 0).withColumn("pages", (F.col("file") % 21).cast("int"))
    return within_document(rows, users, "file").select("seq", "file", "page", "value", "confidence")


PAGE_BOUNDS = f"""WITH {EXTRACTED}, r AS (SELECT *, file % 11 <> 0 AND page >= 1 AND page <= file % 21 AS there FROM extracted)
SELECT seq, file, page, CASE WHEN there THEN value END AS value, CASE WHEN there THEN 'high' ELSE 'low' END AS confidence FROM r"""


def remove_fields(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows without the fields that `gone` (file, field) names for their file."""
    return rows.join(gone, ["file", "field"], "left_anti")


def delete_nth(rows: DataFrame, gone: DataFrame, order: str = "seq") -> DataFrame:
    """Rows without the occurrences that `gone` (file, page, field, occ) names, occ counting a field's values on the page from 0."""
    occ = F.row_number().over(Window.partitionBy("file", "page", "field").orderBy(order)) - 1
    return rows.withColumn("occ", occ).join(gone, ["file", "page", "field", "occ"], "left_anti")


def eav_delete(spark, sf_dir: str) -> DataFrame:
    """Without the errors of every fourth user, and without the second value of a field on each even page."""
    rows = extracted(spark, sf_dir)
    users = rows.select("file").distinct().filter(F.col("file") % 4 == 0).withColumn("field", F.lit("error"))
    second = rows.filter(F.col("page") % 2 == 0).select("file", "page", "field").distinct().withColumn("occ", F.lit(1))
    return delete_nth(remove_fields(rows, users), second).select("seq", "file", "page", "field", "value", "occ")


EAV_DELETE = f"""WITH {EXTRACTED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, page, field ORDER BY seq) - 1 AS INTEGER) AS occ FROM extracted WHERE NOT (field = 'error' AND file % 4 = 0))
SELECT seq, file, page, field, value, occ FROM r WHERE NOT (page % 2 = 0 AND occ = 1)"""


def update_batches(batches: DataFrame, changes: DataFrame) -> DataFrame:
    """Batches (id, name, doc_type) after changes (id, name, doc_type): null leaves as it is; an empty or `auto` type unsets it."""
    c = changes.select("id", F.col("name").alias("_name"), F.col("doc_type").alias("_type"))
    kind = F.when(F.col("_type").isNull(), F.col("doc_type")).when(~F.col("_type").isin("", "auto"), F.col("_type"))
    return batches.join(c, "id", "left").select("id", F.coalesce("_name", "name").alias("name"), kind.alias("doc_type"))


def batch_update(spark, sf_dir: str) -> DataFrame:
    """Customers as batches; every second one is changed in one of four ways, every seventh is deleted."""
    c = table(spark, sf_dir, "customer")
    batches = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("doc_type"))
    kinds = F.element_at(F.array(F.lit(None).cast("string"), F.lit(""), F.lit("auto"), F.lit("lease")), (F.expr("c_custkey div 2 % 4") + 1).cast("int"))
    changes = c.filter(F.col("c_custkey") % 2 == 0).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("renamed "), F.col("c_custkey"))).alias("name"), kinds.alias("doc_type"))
    gone = c.filter(F.col("c_custkey") % 7 == 0).select(F.col("c_custkey").alias("id"))
    return update_batches(batches, changes).join(gone, "id", "left_anti")


BATCH_UPDATE = """SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'renamed ' || c_custkey ELSE c_name END AS name,
  CASE WHEN c_custkey % 2 = 1 THEN c_mktsegment ELSE CASE c_custkey // 2 % 4 WHEN 0 THEN c_mktsegment WHEN 3 THEN 'lease' END END AS doc_type FROM customer WHERE c_custkey % 7 <> 0"""


def usage_payload(spark, sf_dir: str) -> DataFrame:
    """Usage events as they are sent: pages as a whole number, left out unless positive; without any, no event of kind view."""
    e = table(spark, sf_dir, "events")
    pages = F.floor("value").cast("long")
    body = F.to_json(F.struct(F.col("user_id"), F.col("event_type").alias("kind"), F.when(pages > 0, pages).alias("pages_extracted")))
    return e.filter((F.col("event_type") != "view") | (pages > 0)).select(F.col("event_id").alias("id"), body.alias("body"))


USAGE_PAYLOAD = """SELECT event_id AS id, '{"user_id":' || user_id || ',"kind":"' || event_type || '"' || CASE WHEN floor(value) > 0 THEN ',"pages_extracted":' || CAST(floor(value) AS BIGINT) ELSE '' END || '}' AS body
FROM events WHERE event_type <> 'view' OR floor(value) > 0"""

# Characters that are misread for each other.
MISREAD = {"0": "oOQD", "o": "0", "O": "0", "1": "lI|", "l": "1I", "I": "1l", "5": "Ss", "S": "5", "2": "Zz", "8": "B", "B": "8", "6": "G", "G": "6"}


def spellings(token: Column, most: int = 8) -> Column:
    """The token, its lower case, and if it has a digit the tokens with one misread character replaced throughout, in the order of MISREAD; at
    most `most`."""
    swaps = [F.when(F.contains(token, F.lit(a)), F.replace(token, F.lit(a), F.lit(b))) for a, bs in MISREAD.items() for b in bs]
    more = F.when(token.rlike(r"\d"), F.filter(F.array(*swaps), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.array(token, F.lower(token)), more)), 1, most)


def token_spellings(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(spellings(F.concat(F.col("p_brand"), F.lit("-"), F.col("p_size"))), " ").alias("spellings"))


_SWAPS = ", ".join(f"CASE WHEN contains(t, '{a}') THEN replace(t, '{a}', '{b}') END" for a, bs in MISREAD.items() for b in bs)
TOKEN_SPELLINGS = f"""WITH p AS (SELECT p_partkey, p_brand || '-' || p_size AS t FROM part), s AS (SELECT p_partkey, unnest(list_filter([t, lower(t), {_SWAPS}], lambda x: x IS NOT NULL)) AS s, generate_subscripts(list_filter([t, lower(t), {_SWAPS}], lambda x: x IS NOT NULL), 1) AS i FROM p),
d AS (SELECT p_partkey, s, min(i) AS i FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS k FROM d)
SELECT p_partkey, string_agg(s, ' ' ORDER BY i) AS spellings FROM r WHERE k <= 8 GROUP BY p_partkey"""


def label_queries(field: Column, synonyms: dict[str, list[str]]) -> Column:
    """The phrases a field's label may be printed as: its synonyms, else its name with spaces."""
    known = F.lit(None).cast("array<string>")
    for name, phrases in synonyms.items():
        known = F.when(field == name, F.array(*[F.lit(p) for p in phrases])).otherwise(known)
    return F.coalesce(known, F.array(F.replace(field, F.lit("_"), F.lit(" "))))


def field_labels(spark, sf_dir: str) -> DataFrame:
    """The fields of all events and part types, of which two have synonyms."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("field")).union(table(spark, sf_dir, "part").select(F.replace(F.lower("p_type"), F.lit(" "), F.lit("_")))).distinct()
    return names.select("field", F.explode(label_queries(F.col("field"), {"purchase": ["amount due", "total due"], "view": ["pages"]})).alias("label"))


FIELD_LABELS = """WITH f AS (SELECT event_type AS field FROM events UNION SELECT replace(lower(p_type), ' ', '_') FROM part)
SELECT field, unnest(CASE field WHEN 'purchase' THEN ['amount due', 'total due'] WHEN 'view' THEN ['pages'] ELSE [replace(field, '_', ' ')] END) AS label FROM f"""

QUERIES = {
    "field_clean": (field_clean, FIELD_CLEAN),
    "field_dates": (field_dates, FIELD_DATES),
    "page_bounds": (page_bounds, PAGE_BOUNDS),
    "eav_delete": (eav_delete, EAV_DELETE),
    "batch_update": (batch_update, BATCH_UPDATE),
    "usage_payload": (usage_payload, USAGE_PAYLOAD),
    "token_spellings": (token_spellings, TOKEN_SPELLINGS),
    "field_labels": (field_labels, FIELD_LABELS),
}
