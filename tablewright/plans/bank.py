"""Bank statements: flattening, month spine, running balances, averages, trailing metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.amounts import parse_number
from ..functions.dates import parse_date
from ..sources.tables import TRANSACTIONS, transactions
from .utility import money

TRAILING = {1: 12.0, 3: 4.0, 6: 2.0, 9: 12.0 / 9, 12: 1.0}


def statements(rows: DataFrame) -> DataFrame:
    """One statement per account and month: sums of credits and of debits without sign, the date of the last movement, and
    the beginning balance of the first."""
    return rows.groupBy("account", "property", F.trunc("day", "month").alias("month")).agg(
        F.sum(F.when(F.col("kind") == "credit", F.col("amount"))).alias("credits"),
        F.sum(F.when(F.col("kind") == "debit", F.abs("amount"))).alias("debits"),
        F.min_by("beginning", "seq").alias("beginning"),
        F.max("day").alias("statement_date"),
        F.max("seq").alias("seq"),
    )


STATEMENTS = f"""{TRANSACTIONS}, statements AS (
  SELECT account, property, CAST(date_trunc('month', day) AS DATE) AS month, sum(amount) FILTER (kind = 'credit') AS credits, sum(abs(amount)) FILTER (kind = 'debit') AS debits,
    arg_min(beginning, seq) AS beginning, max(day) AS statement_date, max(seq) AS seq
  FROM transactions GROUP BY ALL)"""


def flatten(fields: DataFrame) -> DataFrame:
    """Long-form fields (session, filename, seq, field, value) to one item per file: credits, debits, and of the other fields
    the first that isn't blank. The key is the session, else the filename. A credit in parentheses counts as 0, a debit in
    parentheses as its amount, as statements print them."""
    key = F.coalesce(F.nullif(F.trim("session"), F.lit("")), F.col("filename"))
    first = lambda f: F.min_by(F.when((F.col("field") == f) & (F.trim("value") != ""), F.col("value")), F.when((F.col("field") == f) & (F.trim("value") != ""), F.col("seq"))).alias(f)
    return fields.groupBy(key.alias("key")).agg(
        first("account"), first("property"),
        F.sum(F.when(F.col("field") == "credit", F.coalesce(parse_number(F.col("value")), F.lit(0.0)))).alias("credits"),
        F.sum(F.when(F.col("field") == "debit", F.abs(F.coalesce(parse_number(F.regexp_replace("value", r"[()]", "")), F.lit(0.0))))).alias("debits"),
    )


def bank_flatten(spark, sf_dir: str) -> DataFrame:
    """Each customer is a file; orders are its movements, as printed text, every ninth in parentheses."""
    t = transactions(spark, sf_dir)
    whole = F.concat(F.lit("$"), F.format_number(F.floor("amount"), 0))
    printed = F.when(F.col("seq") % 9 == 0, F.concat(F.lit("("), whole, F.lit(")"))).otherwise(whole)
    t = t.select(F.when(F.col("account") % 2 == 0, F.concat(F.lit("s"), F.col("account"))).otherwise(" ").alias("session"), F.concat(F.lit("f"), F.col("account")).alias("filename"), "seq", F.explode(F.array(
        F.struct(F.col("kind").alias("field"), printed.alias("value")), F.struct(F.lit("property").alias("field"), F.when(F.col("seq") % 2 == 0, "").otherwise(F.col("property")).alias("value")),
        F.struct(F.lit("account").alias("field"), F.col("account").cast("string").alias("value")))).alias("x")).select("session", "filename", "seq", "x.field", "x.value")
    return flatten(t)


BANK_FLATTEN = f"""WITH {TRANSACTIONS}
SELECT CASE WHEN account % 2 = 0 THEN 's' ELSE 'f' END || account AS key, CAST(account AS VARCHAR) AS account, max(CASE WHEN seq % 2 <> 0 THEN property END) AS property,
  CAST(sum(CASE WHEN seq % 9 = 0 THEN 0 ELSE floor(amount) END) FILTER (kind = 'credit') AS DOUBLE) AS credits, CAST(sum(floor(amount)) FILTER (kind = 'debit') AS DOUBLE) AS debits
FROM transactions GROUP BY account"""


def group_key(*choices: Column, otherwise: str) -> Column:
    """The first choice that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in choices], F.lit(otherwise))


def bank_property_group(spark, sf_dir: str) -> DataFrame:
    """Accounts by property; here every fifth account has a blank property and every fifteenth a blank account."""
    t = transactions(spark, sf_dir)
    prop = F.when(F.col("account") % 5 == 0, F.lit("  ")).otherwise(F.col("property"))
    account = F.when(F.col("account") % 15 == 0, F.lit("")).otherwise(F.concat(F.lit("A"), F.col("account")))
    keyed = t.withColumn("group", group_key(prop, account, otherwise="Unknown Property"))
    return keyed.groupBy("group").agg(F.countDistinct("account").alias("n_accounts"), F.count("*").alias("n_movements"), F.sum("amount").cast("double").alias("amount"))


BANK_PROPERTY_GROUP = f"""WITH {TRANSACTIONS}, keyed AS (SELECT *, coalesce(nullif(trim(CASE WHEN account % 5 = 0 THEN '  ' ELSE property END), ''), nullif(trim(CASE WHEN account % 15 = 0 THEN '' ELSE 'A' || account END), ''), 'Unknown Property') AS "group" FROM transactions)
SELECT "group", count(DISTINCT account) AS n_accounts, count(*) AS n_movements, CAST(sum(amount) AS DOUBLE) AS amount FROM keyed GROUP BY 1"""


def spine(anchor: Column, earliest: Column, months: int = 12) -> Column:
    """Month ends up to the anchor's month: 12 of them, or more, back to the earliest date's month."""
    end = F.trunc(anchor, "month")
    start = F.least(F.add_months(end, -(months - 1)), F.trunc(F.coalesce(earliest, anchor), "month"))
    return F.transform(F.sequence(start, end, F.expr("interval 1 month")), lambda d: F.last_day(d))


def spined(items: DataFrame, key: str = "property") -> DataFrame:
    """One row per key and month of its spine, with the sums of that month's statements; months without any are blank."""
    sums = items.groupBy(key, F.last_day("month").alias("month_end")).agg(F.sum("credits").alias("credits"), F.sum("debits").alias("debits"), F.count("*").alias("n"))
    months = items.groupBy(key).agg(F.max("statement_date").alias("anchor"), F.min("statement_date").alias("earliest"), F.min_by("beginning", "seq").alias("beginning"))
    months = months.select(key, "beginning", F.explode(spine(F.col("anchor"), F.col("earliest"))).alias("month_end"))
    return months.join(sums, [key, "month_end"], "left")


SPINED = f"""{STATEMENTS}, bounds AS (SELECT property, max(statement_date) AS anchor, min(statement_date) AS earliest, arg_min(beginning, seq) AS beginning FROM statements GROUP BY property),
spine AS (SELECT property, beginning, CAST(last_day(CAST(m AS DATE)) AS DATE) AS month_end FROM (SELECT property, beginning, unnest(generate_series(least(date_trunc('month', anchor) - INTERVAL 11 MONTH, CAST(date_trunc('month', earliest) AS TIMESTAMP)), CAST(date_trunc('month', anchor) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m FROM bounds)),
sums AS (SELECT property, last_day(month) AS month_end, sum(credits) AS credits, sum(debits) AS debits, count(*) AS n FROM statements GROUP BY 1, 2),
spined AS (SELECT s.property, s.month_end, s.beginning, credits, debits, n FROM spine s LEFT JOIN sums USING (property, month_end))"""


def bank_month_spine(spark, sf_dir: str) -> DataFrame:
    return spined(statements(transactions(spark, sf_dir))).select("property", F.date_format("month_end", "MM/dd/yyyy").alias("month_end"), "n", *money("credits", "debits"))


BANK_MONTH_SPINE = f"WITH {SPINED} SELECT property, strftime(month_end, '%m/%d/%Y') AS month_end, n, CAST(credits AS DOUBLE) AS credits, CAST(debits AS DOUBLE) AS debits FROM spined"


def balances(rows: DataFrame, key: str = "property", adjustments: Column | None = None) -> DataFrame:
    """Unadjusted balance: beginning plus deposits less withdrawals so far; adjusted: with actual deposits, which are deposits
    less adjustments. Blank months count as zero."""
    adjust = F.lit(0) if adjustments is None else adjustments
    w = Window.partitionBy(key).orderBy("month_end").rowsBetween(Window.unboundedPreceding, 0)
    c, d = F.coalesce("credits", F.lit(0)), F.coalesce("debits", F.lit(0))
    rows = rows.withColumn("actual", c - adjust)
    return rows.withColumns({"unadjusted": F.col("beginning") + F.sum(c - d).over(w), "adjusted": F.col("beginning") + F.sum(F.col("actual") - d).over(w)})


def bank_running_balance(spark, sf_dir: str) -> DataFrame:
    """Adjustments here are a tenth of the months' statements in money."""
    rows = balances(spined(statements(transactions(spark, sf_dir))), adjustments=F.coalesce((F.col("n") * 10).cast("decimal(18,2)"), F.lit(0)))
    return rows.select("property", F.col("month_end").cast("string").alias("month_end"), *money("actual", "unadjusted", "adjusted"))


BANK_RUNNING_BALANCE = f"""WITH {SPINED}
SELECT property, CAST(month_end AS VARCHAR) AS month_end, CAST(coalesce(credits, 0) - coalesce(n * 10, 0) AS DOUBLE) AS actual,
  CAST(beginning + sum(coalesce(credits, 0) - coalesce(debits, 0)) OVER w AS DOUBLE) AS unadjusted, CAST(beginning + sum(coalesce(credits, 0) - coalesce(n * 10, 0) - coalesce(debits, 0)) OVER w AS DOUBLE) AS adjusted
FROM spined WINDOW w AS (PARTITION BY property ORDER BY month_end ROWS UNBOUNDED PRECEDING)"""


def totals_and_averages(rows: DataFrame, key: str = "property") -> DataFrame:
    """Totals, and averages that skip blank months (for actual deposits, zero ones too); no month at all averages 0."""
    return rows.groupBy(key).agg(
        F.sum("credits").alias("credits"), F.sum("debits").alias("debits"),
        F.coalesce(F.avg(F.col("credits").cast("double")), F.lit(0.0)).alias("avg_credits"), F.coalesce(F.avg(F.col("debits").cast("double")), F.lit(0.0)).alias("avg_debits"),
        F.coalesce(F.avg(F.nullif(F.coalesce("credits", F.lit(0)).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("avg_actual"), F.count("credits").alias("n_months"),
    )


def bank_totals_avg(spark, sf_dir: str) -> DataFrame:
    out = totals_and_averages(spined(statements(transactions(spark, sf_dir))))
    return out.select("property", "n_months", *money("credits", "debits"), *[F.round(c, 4).alias(c) for c in ("avg_credits", "avg_debits", "avg_actual")])


BANK_TOTALS_AVG = f"""WITH {SPINED}
SELECT property, count(credits) AS n_months, CAST(sum(credits) AS DOUBLE) AS credits, CAST(sum(debits) AS DOUBLE) AS debits, round(coalesce(avg(CAST(credits AS DOUBLE)), 0), 4) AS avg_credits, round(coalesce(avg(CAST(debits AS DOUBLE)), 0), 4) AS avg_debits,
  round(coalesce(avg(nullif(CAST(coalesce(credits, 0) AS DOUBLE), 0)), 0), 4) AS avg_actual
FROM spined GROUP BY property"""


def trailing(rows: DataFrame, key: str = "property") -> DataFrame:
    """Sums of the last 1, 3, 6, 9 and 12 months of the spine, annualised, and their variance against the balance sheet's
    annual figure (here the 12-month sum), 0 where that is 0."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("month_end")))
    recent = rows.withColumn("back", last).filter(F.col("back") <= max(TRAILING))
    sums = recent.groupBy(key).agg(*[F.sum(F.when(F.col("back") <= n, F.coalesce("credits", F.lit(0))).otherwise(0)).alias(f"t{n}") for n in TRAILING])
    stacked = sums.select(key, F.col("t12").alias("annual"), F.explode(F.array(*[F.struct(F.lit(n).alias("months"), F.lit(x).alias("factor"), F.col(f"t{n}").cast("double").alias("total")) for n, x in TRAILING.items()])).alias("x"))
    out = stacked.select(key, F.col("annual").cast("double").alias("annual"), "x.months", "x.total", (F.col("x.total") * F.col("x.factor")).alias("annualised"))
    return out.withColumn("variance", F.when(F.col("annual") != 0, (F.col("annualised") - F.col("annual")) / F.col("annual")).otherwise(0.0))


def bank_trailing(spark, sf_dir: str) -> DataFrame:
    out = trailing(spined(statements(transactions(spark, sf_dir))))
    return out.select("property", "months", "total", F.round("annualised", 4).alias("annualised"), F.round("variance", 6).alias("variance"))


BANK_TRAILING = f"""WITH {SPINED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY month_end DESC) AS back FROM spined),
n(months, factor) AS (VALUES (1, 12.0::DOUBLE), (3, 4.0::DOUBLE), (6, 2.0::DOUBLE), (9, 12.0::DOUBLE / 9), (12, 1.0::DOUBLE)),
trail AS (SELECT property, months, factor, CAST(sum(CASE WHEN back <= months THEN coalesce(credits, 0) ELSE 0 END) AS DOUBLE) AS total, CAST(sum(CASE WHEN back <= 12 THEN coalesce(credits, 0) ELSE 0 END) AS DOUBLE) AS annual FROM ranked, n GROUP BY ALL)
SELECT property, months, total, round(total * factor, 4) AS annualised, round(CASE WHEN annual <> 0 THEN (total * factor - annual) / annual ELSE 0 END, 6) AS variance FROM trail"""


def last_statements(items: DataFrame) -> DataFrame:
    """Within an account's month the last statement overwrites the others; properties and months then sum over accounts."""
    one = items.groupBy("property", "account", "month").agg(F.max_by("credits", "seq").alias("credits"), F.max_by("debits", "seq").alias("debits"))
    return one.groupBy("property", "month").agg(F.sum("credits").alias("credits"), F.sum("debits").alias("debits"), F.count("*").alias("n_accounts"))


def bank_last_statement(spark, sf_dir: str) -> DataFrame:
    """Each order is a statement of its own here."""
    t = transactions(spark, sf_dir)
    items = t.select("property", "account", F.trunc("day", "month").alias("month"), "seq", F.when(F.col("kind") == "credit", F.col("amount")).otherwise(0).alias("credits"), F.when(F.col("kind") == "debit", F.col("amount")).otherwise(0).alias("debits"))
    return last_statements(items).select("property", F.col("month").cast("string").alias("month"), "n_accounts", *money("credits", "debits"))


BANK_LAST_STATEMENT = f"""WITH {TRANSACTIONS}, ranked AS (SELECT *, date_trunc('month', day) AS month, row_number() OVER (PARTITION BY property, account, date_trunc('month', day) ORDER BY seq DESC) AS r FROM transactions)
SELECT property, CAST(CAST(month AS DATE) AS VARCHAR) AS month, count(*) AS n_accounts, CAST(sum(CASE WHEN kind = 'credit' THEN amount ELSE 0 END) AS DOUBLE) AS credits, CAST(sum(CASE WHEN kind = 'debit' THEN amount ELSE 0 END) AS DOUBLE) AS debits FROM ranked WHERE r = 1 GROUP BY property, month"""

def by_date(date: Column, seq: Column) -> Column:
    """The order of an account's statements: by date, those without a valid one before all later than 1970, then as they came."""
    return F.struct(F.coalesce(date, F.lit("1970-01-01").cast("date")).alias("day"), seq.alias("seq"))


def statement_order(spark, sf_dir: str) -> DataFrame:
    """Each account's statements in order, as printed dates, some of them no dates: the account's opening balance is the first one's."""
    t = transactions(spark, sf_dir)
    printed = F.when(F.col("seq") % 7 == 0, "n/a").when(F.col("seq") % 11 == 0, "").otherwise(F.date_format("day", "M/d/yyyy"))
    t = t.select("account", "seq", "amount", parse_date(printed).alias("date"))
    place = Window.partitionBy("account").orderBy(by_date(F.col("date"), F.col("seq")))
    return t.select("account", "seq", F.row_number().over(place).alias("place"), F.first("amount").over(place.rowsBetween(Window.unboundedPreceding, 0)).cast("double").alias("opening"))


STATEMENT_ORDER = f"""WITH {TRANSACTIONS}, d AS (SELECT account, seq, amount, CASE WHEN seq % 7 <> 0 AND seq % 11 <> 0 THEN day ELSE DATE '1970-01-01' END AS date FROM transactions)
SELECT account, seq, CAST(row_number() OVER w AS INTEGER) AS place, CAST(first_value(amount) OVER w AS DOUBLE) AS opening FROM d WINDOW w AS (PARTITION BY account ORDER BY date, seq)"""

QUERIES = {
    "statement_order": (statement_order, STATEMENT_ORDER),
    "bank_flatten": (bank_flatten, BANK_FLATTEN),
    "bank_property_group": (bank_property_group, BANK_PROPERTY_GROUP),
    "bank_month_spine": (bank_month_spine, BANK_MONTH_SPINE),
    "bank_running_balance": (bank_running_balance, BANK_RUNNING_BALANCE),
    "bank_totals_avg": (bank_totals_avg, BANK_TOTALS_AVG),
    "bank_trailing": (bank_trailing, BANK_TRAILING),
    "bank_last_statement": (bank_last_statement, BANK_LAST_STATEMENT),
}
