"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import is_numeric_token, normalise_amount, parse_number
from ..functions.dates import extract_date, normalise_date, normalise_range, parse_date
from ..functions.text import sanitise
from ..sources.tables import table


def amount_normalise(spark, sf_dir: str) -> DataFrame:
    """Order totals as they are printed: with dollar and commas, bare, in parentheses, doubled, or not a number."""
    o = table(spark, sf_dir, "orders")
    cents = F.col("o_totalprice").cast("decimal(18,2)")
    whole = F.floor("o_totalprice").cast("string")
    raw = F.expr("o_orderkey % 5")
    o = o.withColumn("raw", F.when(raw == 0, F.concat(F.lit("$"), F.format_number(cents, 2))).when(raw == 1, F.concat(whole, whole)).when(raw == 2, F.concat(F.lit("("), cents.cast("string"), F.lit(")"))).when(raw == 3, F.lit("n/a")).otherwise(F.concat(F.lit(" "), whole, F.lit(" USD"))))
    return o.select("o_orderkey", normalise_amount(F.col("raw")).alias("amount"), normalise_amount(F.col("raw"), strict=True).alias("strict"))


AMOUNT_NORMALISE = """WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS c, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS w FROM orders),
t AS (SELECT *, CASE WHEN length(w) % 2 = 0 AND left(w, length(w) // 2) = right(w, length(w) // 2) THEN left(w, length(w) // 2) ELSE w END AS h,
  CASE WHEN length(c) % 2 = 0 AND left(c, length(c) // 2) = right(c, length(c) // 2) THEN left(c, length(c) // 2) ELSE c END AS hc FROM o)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN c WHEN 1 THEN w || '.00' WHEN 2 THEN hc WHEN 3 THEN 'n/a' ELSE h || '.00' END AS amount,
  CASE o_orderkey % 5 WHEN 0 THEN c WHEN 1 THEN w || w || '.00' WHEN 2 THEN c WHEN 3 THEN 'n/a' ELSE w || '.00' END AS strict FROM t"""


def sanitize_value(spark, sf_dir: str) -> DataFrame:
    """Every turn of every conversation, tagged, with a hidden number, or printed twice."""
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("[sig|req|signer1] "), F.col("text"), F.lit(" Doc ID: 0af3 01010101"))).when(F.col("turn") % 3 == 1, F.concat(F.col("text"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", sanitise(text).alias("value"))


SANITIZE_VALUE = r"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '[sig|req|signer1] ' || text || ' Doc ID: 0af3 01010101' WHEN turn % 3 = 1 THEN text || ' ' || text ELSE text END AS s FROM conversations),
d AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '(?i)\[(?:text|sig|date|initial|checkbox|radio|attachment|note)[^\]]*\]', '', 'g'), '(?i)\bDoc(?:ument)?\s*ID\s*:\s*\S+', '', 'g'), '(?i)\[[a-z]+\|[^\]]{0,120}\]', '', 'g'), '[^\p{L}\p{N}\p{P}\p{Z}\p{Sc}\p{Sm}]', '', 'g'), '\b[01]{8,}\b', '', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS s FROM c)
SELECT conv_id, turn, nullif(CASE WHEN length(s) % 2 = 1 AND length(s) > 2 AND substr(s, length(s) // 2 + 1, 1) = ' ' AND left(s, length(s) // 2) = right(s, length(s) // 2) THEN left(s, length(s) // 2)
  WHEN length(s) >= 2 AND length(s) % 2 = 0 AND left(s, length(s) // 2) = right(s, length(s) // 2) THEN left(s, length(s) // 2) ELSE s END, '') AS value FROM d"""


def printed_dates(spark, sf_dir: str) -> DataFrame:
    """Every order's date in one of twelve ways, some within a range, some that only one of the two readers takes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    f = lambda p, c="d": F.date_format(c, p)
    later, k = F.date_add("d", 40), F.col("o_orderkey") % 12
    raw = (
        F.when(k == 0, f("MMM d, yyyy")).when(k == 1, f("MM/dd/yyyy")).when(k == 2, f("yyyy-MM-dd")).when(k == 3, F.concat(F.lit("Statement Period: "), f("MMMM d, yyyy"), F.lit(" to "), F.date_format(later, "MMMM d, yyyy")))
        .when(k == 4, f("d MMM yyyy")).when(k == 5, F.concat(f("MM/dd/yyyy"), F.lit("-"), F.date_format(later, "MM/dd/yyyy"))).when(k == 6, F.concat(f("MMMM d"), F.lit("th "), f("yyyy"))).when(k == 7, f("M / d / yyyy"))
        .when(k == 8, f("MMM d. yyyy")).when(k == 9, f("yyyy MMM d")).when(k == 10, f("MM dd yyyy")).otherwise(F.concat(f("MMM d"), F.lit(" - "), F.date_format(later, "MMM d, yyyy"), F.lit(" to "), F.date_format(F.date_add("d", 80), "MMM d yyyy")))
    )
    return o.withColumn("raw", raw)


def date_normalise(spark, sf_dir: str) -> DataFrame:
    o = printed_dates(spark, sf_dir)
    # the struct is taken apart by a generator, so that it isn't worked out once for each of its fields
    return o.select("o_orderkey", F.inline(F.array(normalise_range(F.col("raw")))))


_PRINTED = "p AS (SELECT o_orderkey, o_orderkey % 12 AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 40 AS later, CAST(o_orderdate AS DATE) + 80 AS last FROM orders)"
#: Texts in which no date is found come back as they are.
DATE_NORMALISE = f"""WITH {_PRINTED}, kept AS (SELECT *, CASE k WHEN 8 THEN strftime(d, '%b %-d. %Y') WHEN 9 THEN strftime(d, '%Y %b %-d') WHEN 10 THEN strftime(d, '%m %d %Y') END AS kept FROM p)
SELECT o_orderkey, coalesce(kept, strftime(CASE k WHEN 11 THEN later ELSE d END, '%m/%d/%Y')) AS first, coalesce(kept, strftime(CASE k WHEN 3 THEN later WHEN 11 THEN last ELSE d END, '%m/%d/%Y')) AS last FROM kept"""


def date_extract(spark, sf_dir: str) -> DataFrame:
    return printed_dates(spark, sf_dir).select("o_orderkey", extract_date(F.col("raw")).alias("date"))


#: October's first letter is a zero where it starts the text; a range whose second day has two digits reads as day, month and two-digit year.
DATE_EXTRACT = f"""WITH {_PRINTED} SELECT o_orderkey, CASE
  WHEN k IN (0, 6, 8) AND month(d) = 10 THEN 'NONE'
  WHEN k = 7 THEN 'NONE'
  WHEN k = 11 AND day(later) >= 10 THEN coalesce(strftime(try_strptime(format('{{:02d}}/{{:02d}}/{{:04d}}', month(later), day(d), 2000 + day(later)), '%m/%d/%Y'), '%m/%d/%Y'), 'NONE')
  WHEN k = 11 THEN strftime(later, '%m/%d/%Y') ELSE strftime(d, '%m/%d/%Y') END AS date FROM p"""


def numeric_token(spark, sf_dir: str) -> DataFrame:
    """Words of every document that are numbers, as table cells go."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    return d.select("doc_id", F.size(words).alias("n_words"), F.size(F.filter(words, is_numeric_token)).alias("n_numeric"))


NUMERIC_TOKEN = r"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, CAST(len(list_filter(w, lambda x: regexp_matches(regexp_replace(x, '[,.\-()$%]', '', 'g'), '^[0-9]+$'))) AS INTEGER) AS n_numeric
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '') AS w FROM documents)"""


def coerce(kind, raw) -> dict:
    """Typed cells by kind (date, amount, percent, year, count, number, text): as_date, as_number, as_text; what doesn't parse
    stays as text."""
    number = parse_number(F.regexp_replace(raw, "%", ""))
    date = F.when(kind == "date", parse_date(raw))
    value = F.when(kind.isin("amount", "number"), number).when(kind == "percent", F.when(number > 1, number / 100).otherwise(number)).when(kind.isin("year", "count"), F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1).try_cast("double"))
    return {"as_date": date, "as_number": value, "as_text": F.when(date.isNull() & value.isNull(), raw)}


def typed_coerce(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("k", F.expr("c_custkey % 7"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("date", "amount", "percent", "year", "count", "number", "text")]), (F.col("k") + 1).cast("int"))
    bal = F.col("c_acctbal").cast("decimal(18,2)")
    raw = F.when(F.col("k") == 0, F.concat(F.lit("02/"), F.lpad((F.col("c_custkey") % 31 + 1).cast("string"), 2, "0"), F.lit("/24"))).when(F.col("k") == 1, F.concat(F.lit("$"), bal.cast("string"))).when(F.col("k") == 2, F.concat((F.col("c_custkey") % 100).cast("string"), F.lit("%"))).when(F.col("k") == 3, F.concat((F.col("c_custkey") % 200 + 1900).cast("string"), F.lit(" (est)"))).when(F.col("k") == 4, F.col("c_name")).otherwise(bal.cast("string"))
    out = coerce(kind, raw)
    return c.select("c_custkey", out["as_date"].cast("string").alias("as_date"), out["as_number"].alias("as_number"), out["as_text"].alias("as_text"))


TYPED_COERCE = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN CAST(DATE '2024-02-01' + CAST(c_custkey % 31 AS INTEGER) AS VARCHAR) END AS as_date,
  CASE c_custkey % 7 WHEN 1 THEN c_acctbal WHEN 2 THEN CASE WHEN c_custkey % 100 > 1 THEN (c_custkey % 100) / 100.0::DOUBLE ELSE c_custkey % 100 END WHEN 3 THEN c_custkey % 200 + 1900 WHEN 5 THEN c_acctbal END AS as_number,
  CASE c_custkey % 7 WHEN 4 THEN c_name WHEN 6 THEN CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) END AS as_text FROM customer"""

QUERIES = {
    "amount_normalise": (amount_normalise, AMOUNT_NORMALISE),
    "sanitize_value": (sanitize_value, SANITIZE_VALUE),
    "date_normalise": (date_normalise, DATE_NORMALISE),
    "date_extract": (date_extract, DATE_EXTRACT),
    "numeric_token": (numeric_token, NUMERIC_TOKEN),
    "typed_coerce": (typed_coerce, TYPED_COERCE),
}
