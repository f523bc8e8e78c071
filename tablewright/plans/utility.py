"""Monthly utility reconciliation: cells, totals, variance, portfolio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..sources.shared import written
from ..sources.tables import BILLS, bills

MONTH_SQL = "strftime(CASE WHEN day(billing_date) < 15 THEN billing_date - INTERVAL 1 MONTH ELSE billing_date END, '%Y-%m')"


def month_key(day: Column, adjust: bool = True) -> Column:
    """A bill dated before the 15th belongs to the month before, if adjusted."""
    return F.date_format(F.when((F.dayofmonth(day) < 15) & F.lit(adjust), F.add_months(day, -1)).otherwise(day), "yyyy-MM")


def carried(rows: DataFrame, column: str, file: str = "file", order: str = "seq") -> Column:
    """The column's last value that isn't null at or before this row of its file."""
    from pyspark.sql import Window

    return F.last(column, ignorenulls=True).over(Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def cells(rows: DataFrame) -> DataFrame:
    """One row per property, utility, provider, account and month, of bills that come with their other charges and taxes beside them;
    page_cells is for charges that a page has once."""
    return (
        rows.withColumn("month", month_key(F.col("billing_date")))
        .groupBy("property", "utility", "provider", "account", "month")
        .agg(F.sum("amount").alias("bills"), F.sum("other").alias("other"), F.sum("taxes").alias("taxes"), F.count("*").alias("n_bills"))
        .withColumn("recon", F.col("bills") + F.col("other") + F.col("taxes"))
    )


def page_cells(bills: DataFrame, charges: DataFrame) -> DataFrame:
    """As cells, of bills (file, page, seq, property, utility, provider, account, billing_date, amount) and what is printed once on a page: charges (file,
    page, other, taxes), which count in full for every utility on it. A page's first bill of a utility is the one that counts; bills without a number don't.

    row_key is the account, or the file where there's none; row_files has a row's files. Pages without a date have no month, and no charges; a row
    that has no other pages is one blank cell. Charges are one row per page, so joining them
    by page spreads them without growing the bills; both sides share the page's partitioning.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    item = F.struct("seq", "property", "provider", "account", "billing_date", "amount")
    first = bills.filter(F.col("amount").isNotNull()).groupBy("file", "page", "utility").agg(F.min(item).alias("x")).select("file", "page", "utility", "x.*")
    spread = first.join(charges.select("file", "page", "other", "taxes"), ["file", "page"], "left").withColumn("month", month_key(F.col("billing_date")))
    keyed = spread.withColumn("row_key", F.when(blank("account"), F.col("file").cast("string")).otherwise(F.col("account").cast("string")))
    row = ["property", "utility", "provider", "row_key"]
    dated = F.col("month").isNotNull()
    sums = keyed.groupBy(*row, "month").agg(*[F.sum(F.when(dated, F.col(c))).alias(to) for c, to in (("amount", "bills"), ("other", "other"), ("taxes", "taxes"))], F.count_if(dated).alias("n_bills"))
    some = F.max(F.col("month").isNotNull()).over(Window.partitionBy(*row))
    kept = sums.withColumn("_some", some).filter(F.col("month").isNotNull() | ~F.col("_some")).drop("_some")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(18,2)"))
    return kept.withColumn("recon", F.when(F.col("month").isNotNull(), F.col("bills") + zero("other") + zero("taxes")))


def row_files(bills: DataFrame, separator: str = " · ") -> DataFrame:
    """(property, utility, provider, row_key, files): the files that a row's bills came from, by name in the order first seen."""
    key = F.coalesce(F.nullif(F.trim(F.col("account").cast("string")), F.lit("")), F.col("file").cast("string"))
    seen = bills.filter(F.col("amount").isNotNull()).groupBy("property", "utility", "provider", key.alias("row_key"), "file").agg(F.min("at").alias("at"))
    return seen.groupBy("property", "utility", "provider", "row_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"].cast("string")), separator).alias("files"))


def two_to_a_page(spark, sf_dir: str) -> DataFrame:
    """Bills, two to a page; other charges and taxes are those of its first line. Every seventh account is blank, every eleventh bill has no date, some no
    number."""
    b = bills(spark, sf_dir).withColumn("line", F.col("page")).withColumn("page", F.expr("cast((line + 1) div 2 as int)"))
    when = lambda cond, c: F.when(cond, None).otherwise(F.col(c))
    return b.withColumns({"account": when(F.col("account") % 7 == 0, "account"), "billing_date": when((F.col("file") + F.col("page")) % 11 == 0, "billing_date"), "amount": when((F.col("file") + F.col("line")) % 13 == 0, "amount"), "at": F.struct("file", "seq")})


def utility_page_cells(spark, sf_dir: str) -> DataFrame:
    b = two_to_a_page(spark, sf_dir)
    charges = b.groupBy("file", "page").agg(F.min_by("other", "seq").alias("other"), F.min_by("taxes", "seq").alias("taxes"))
    return page_cells(b, charges).select("property", "utility", "provider", "row_key", "month", "n_bills", *money("bills", "other", "taxes", "recon"))


_PAGED = """paged AS (SELECT * REPLACE (CASE WHEN account % 7 <> 0 THEN account END AS account, CAST((page + 1) // 2 AS INTEGER) AS page, CASE WHEN (file + (page + 1) // 2) % 11 <> 0 THEN billing_date END AS billing_date,
  CASE WHEN (file + page) % 13 <> 0 THEN amount END AS amount), page AS line FROM bills)"""
UTILITY_PAGE_CELLS = f"""WITH {BILLS}, {_PAGED},
charges AS (SELECT file, page, other, taxes FROM (SELECT *, row_number() OVER (PARTITION BY file, page ORDER BY seq) AS k FROM paged) WHERE k = 1),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, page, utility ORDER BY seq) AS k FROM paged WHERE amount IS NOT NULL) WHERE k = 1),
spread AS (SELECT f.property, f.utility, f.provider, coalesce(CAST(f.account AS VARCHAR), CAST(f.file AS VARCHAR)) AS row_key, {MONTH_SQL} AS month, f.amount, c.other, c.taxes FROM firsts f LEFT JOIN charges c USING (file, page)),
dated AS (SELECT property, utility, provider, row_key, month, sum(amount) AS bills, sum(other) AS other, sum(taxes) AS taxes, count(*) AS n FROM spread WHERE month IS NOT NULL GROUP BY ALL),
every AS (SELECT DISTINCT property, utility, provider, row_key FROM spread)
SELECT property, utility, provider, row_key, month, coalesce(n, 0) AS n_bills, CAST(bills AS DOUBLE) AS bills, CAST(other AS DOUBLE) AS other, CAST(taxes AS DOUBLE) AS taxes, CAST(bills + coalesce(other, 0) + coalesce(taxes, 0) AS DOUBLE) AS recon
FROM every LEFT JOIN dated USING (property, utility, provider, row_key)"""


def utility_row_files(spark, sf_dir: str) -> DataFrame:
    return row_files(two_to_a_page(spark, sf_dir))


UTILITY_ROW_FILES = f"""WITH {BILLS}, {_PAGED}, seen AS (SELECT property, utility, provider, coalesce(CAST(account AS VARCHAR), CAST(file AS VARCHAR)) AS row_key, file FROM paged WHERE amount IS NOT NULL GROUP BY ALL)
SELECT property, utility, provider, row_key, string_agg(CAST(file AS VARCHAR), ' · ' ORDER BY file) AS files FROM seen GROUP BY ALL"""


def money(*cols: str) -> list[Column]:
    """Exact decimal sums, shown as doubles."""
    return [F.col(c).cast("double").alias(c) for c in cols]


def utility_cells(spark, sf_dir: str) -> DataFrame:
    return cells(bills(spark, sf_dir)).select("property", "utility", "provider", "account", "month", "n_bills", *money("bills", "other", "taxes", "recon"))


CELLS = f"""cells AS (
  SELECT property, utility, provider, account, {MONTH_SQL} AS month, sum(amount) AS bills, sum(other) AS other, sum(taxes) AS taxes, count(*) AS n_bills, sum(amount) + sum(other) + sum(taxes) AS recon
  FROM bills GROUP BY ALL)"""

UTILITY_CELLS = f"WITH {BILLS}, {CELLS} SELECT property, utility, provider, account, month, n_bills, CAST(bills AS DOUBLE) AS bills, CAST(other AS DOUBLE) AS other, CAST(taxes AS DOUBLE) AS taxes, CAST(recon AS DOUBLE) AS recon FROM cells"


def totals(found: DataFrame) -> DataFrame:
    """The report in long form, a row per cell of each level: rows with their totals over months, a total per utility and
    month, all utilities per month, and the property's total. level says which columns are totalled over."""
    every = ["property", "utility", "provider", "account", "month"]
    sets = [every, every[:4], ["property", "utility", "month"], every[:2], ["property", "month"], ["property"]]
    by = lambda names: [F.col(c) for c in names]
    return found.groupingSets([by(s) for s in sets], *by(every)).agg(F.grouping_id().cast("int").alias("level"), F.sum("recon").cast("double").alias("recon"), F.sum("n_bills").alias("n_bills"))


def printed_once(rows: DataFrame) -> DataFrame:
    """Bills whose provider, account and property are printed on a file's first page and on some others."""
    here = (F.col("page") <= 1) | (F.col("page") % 3 == 0)
    return rows.withColumns({c: F.when(here, F.col(c)) for c in ("provider", "account", "property")})


def utility_totals(spark, sf_dir: str) -> DataFrame:
    """Flagship: file order carries provider, account and property forward, bills are bucketed into months and summed with
    other charges and taxes, and every subtotal of the report is added."""
    rows = printed_once(bills(spark, sf_dir))
    return totals(cells(rows.withColumns({c: carried(rows, c) for c in ("provider", "account", "property")})))


_LAST = ", ".join(f"last_value(CASE WHEN page <= 1 OR page % 3 = 0 THEN {c} END IGNORE NULLS) OVER (PARTITION BY file ORDER BY seq ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("provider", "account", "property"))
UTILITY_TOTALS = f"""WITH {BILLS.replace("bills AS (", "all_bills AS (", 1)}, bills AS (SELECT * REPLACE ({_LAST}) FROM all_bills), {CELLS}
SELECT property, utility, provider, account, month, CAST(grouping_id(property, utility, provider, account, month) AS INTEGER) AS level, CAST(sum(recon) AS DOUBLE) AS recon, CAST(sum(n_bills) AS BIGINT) AS n_bills
FROM cells GROUP BY GROUPING SETS ((property, utility, provider, account, month), (property, utility, provider, account), (property, utility, month), (property, utility), (property, month), (property))"""


def variance(found: DataFrame, statement: DataFrame) -> DataFrame:
    """Operating statement less bills, by property, utility and month; where there's no statement it counts as zero."""
    by_month = found.groupBy("property", "utility", "month").agg(F.sum("recon").alias("bills"))
    out = by_month.join(statement, ["property", "utility", "month"], "left")
    return out.withColumn("variance", F.coalesce("statement", F.lit(0).cast("decimal(38,4)")) - F.col("bills"))


def utility_variance(spark, sf_dir: str) -> DataFrame:
    """The statement here has what was billed for Electric and Gas, without taxes."""
    found = cells(bills(spark, sf_dir))
    statement = found.filter(F.col("utility").isin("Electric", "Gas")).groupBy("property", "utility", "month").agg(F.sum(F.col("bills") + F.col("other")).cast("decimal(38,4)").alias("statement"))
    return variance(found, statement).select("property", "utility", "month", *money("bills", "statement", "variance"))


UTILITY_VARIANCE = f"""WITH {BILLS}, {CELLS},
billed AS (SELECT property, utility, month, sum(c.recon) AS billed, sum(c.bills) + sum(c.other) AS stated FROM cells c GROUP BY property, utility, month),
found AS (SELECT property, utility, month, billed AS bills, CASE WHEN utility IN ('Electric', 'Gas') THEN stated END AS statement FROM billed)
SELECT property, utility, month, CAST(bills AS DOUBLE) AS bills, CAST(statement AS DOUBLE) AS statement, CAST(coalesce(statement, 0) - bills AS DOUBLE) AS variance FROM found"""


def portfolio(found: DataFrame) -> DataFrame:
    """Every property against every utility of the portfolio: a utility that a property lacks is zero. Blank properties are
    'Unknown Property'; the portfolio's own row has no property."""
    named = found.withColumn("property", F.when(F.trim("property") == "", None).otherwise(F.col("property"))).fillna({"property": "Unknown Property"})
    sums = named.groupBy("property", "utility").agg(F.sum("recon").alias("recon"))
    utilities = sums.agg(F.sort_array(F.collect_set("utility")).alias("all"))  # a handful of names
    every = sums.groupBy("property").agg(F.map_from_entries(F.collect_list(F.struct("utility", "recon"))).alias("has")).join(utilities)
    rows = every.select("property", "has", F.explode("all").alias("utility")).select("property", "utility", F.coalesce(F.element_at("has", F.col("utility")), F.lit(0).cast("decimal(38,4)")).alias("recon"))
    return rows.unionAll(rows.groupBy("utility").agg(F.sum("recon").alias("recon")).select(F.lit(None).cast("string").alias("property"), "utility", "recon"))


def portfolio_rollup(spark, sf_dir: str) -> DataFrame:
    """NATION_3 has no water here."""
    found = cells(bills(spark, sf_dir)).filter(~((F.col("property") == "NATION_3") & (F.col("utility") == "Water")))
    return portfolio(found).select("property", "utility", *money("recon"))


PORTFOLIO_ROLLUP = f"""WITH {BILLS}, {CELLS}, kept AS (SELECT * FROM cells WHERE NOT (property = 'NATION_3' AND utility = 'Water')),
grid AS (SELECT property, utility FROM (SELECT DISTINCT property FROM kept), (SELECT DISTINCT utility FROM kept)),
filled AS (SELECT g.property, g.utility, coalesce(sum(recon), 0) AS recon FROM grid g LEFT JOIN kept k ON g.property = k.property AND g.utility = k.utility GROUP BY ALL)
SELECT property, utility, CAST(recon AS DOUBLE) AS recon FROM filled
UNION ALL SELECT NULL, utility, CAST(sum(recon) AS DOUBLE) FROM filled GROUP BY utility"""


def bill_month_bucket(spark, sf_dir: str) -> DataFrame:
    rows = bills(spark, sf_dir)
    return rows.groupBy(month_key(F.col("billing_date")).alias("month"), month_key(F.col("billing_date"), False).alias("dated")).agg(F.count("*").alias("n_bills"), F.min("billing_date").cast("string").alias("first_day"), F.max("billing_date").cast("string").alias("last_day"))


BILL_MONTH_BUCKET = f"WITH {BILLS} SELECT {MONTH_SQL} AS month, strftime(billing_date, '%Y-%m') AS dated, count(*) AS n_bills, CAST(min(billing_date) AS VARCHAR) AS first_day, CAST(max(billing_date) AS VARCHAR) AS last_day FROM bills GROUP BY 1, 2"


def bill_dates_set(spark, sf_dir: str) -> DataFrame:
    """The distinct bill dates of each account and utility, in order."""
    rows = bills(spark, sf_dir)
    return rows.groupBy("account", "utility").agg(F.array_join(F.sort_array(F.collect_set(F.col("billing_date").cast("string"))), ",").alias("dates"), F.countDistinct("billing_date").alias("n_dates"))


BILL_DATES_SET = f"WITH {BILLS} SELECT account, utility, string_agg(DISTINCT CAST(billing_date AS VARCHAR), ',' ORDER BY CAST(billing_date AS VARCHAR)) AS dates, count(DISTINCT billing_date) AS n_dates FROM bills GROUP BY account, utility"


def most_common(rows: DataFrame, keys: list[str], column: str, order: str) -> DataFrame:
    """Each group's most frequent value that isn't blank; of equally frequent ones, the first seen."""
    counts = rows.filter(F.trim(F.col(column)) != "").groupBy(*keys, column).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.min_by(column, F.struct(-F.col("n"), F.col("first"))).alias(column), F.max("n").alias("n"))


def header_mode(spark, sf_dir: str) -> DataFrame:
    return most_common(bills(spark, sf_dir).withColumn("at", F.struct("file", "seq")), ["property", "utility"], "provider", "at")


HEADER_MODE = f"""WITH {BILLS}, counted AS (SELECT property, utility, provider, count(*) AS n, min({{'f': file, 's': seq}}) AS first FROM bills GROUP BY ALL)
SELECT property, utility, provider, n FROM (SELECT *, row_number() OVER (PARTITION BY property, utility ORDER BY n DESC, first) AS r FROM counted) WHERE r = 1"""


def timeline(found: DataFrame) -> list[str]:
    """The months that are seen, in order; a list of a few hundred at most."""
    return [r[0] for r in found.select("month").distinct().orderBy("month").collect()]


def months_across(found: DataFrame, months: list[str]) -> DataFrame:
    """A row per property, utility, provider and account, a column per month; months without a bill stay blank. With the row's total."""
    row = ["property", "utility", "provider", "account"]
    of = found.groupBy(*row, "month").agg(F.sum("recon").alias("recon")).groupBy(*row).agg(F.map_from_entries(F.filter(F.collect_list(F.struct("month", "recon")), lambda x: x["month"].isNotNull())).alias("by"), F.coalesce(F.sum(F.when(F.col("month").isin(months), F.col("recon"))), F.lit(0)).alias("total"))
    return of.select(*row, *[F.element_at("by", F.lit(m)).alias(m) for m in months], "total")


def utility_pivot(spark, sf_dir: str) -> DataFrame:
    found = written(cells(bills(spark, sf_dir)).select("property", "utility", "provider", "account", "month", "recon"), "cells")
    months = timeline(found)
    return months_across(found, months).select("property", "utility", "provider", "account", *[F.col(f"`{m}`").cast("double").alias(f"m{m.replace('-', '')}") for m in months], F.col("total").cast("double").alias("total"))


_ALL_MONTHS = [f"{m // 12}-{m % 12 + 1:02d}" for m in range(1994 * 12 + 11, 2001 * 12 + 10)]
UTILITY_PIVOT = f"""WITH {BILLS}, {CELLS} SELECT property, utility, provider, account, {', '.join(f"CAST(sum(recon) FILTER (month = '{m}') AS DOUBLE) AS m{m.replace('-', '')}" for m in _ALL_MONTHS)}, CAST(sum(recon) AS DOUBLE) AS total
FROM cells GROUP BY property, utility, provider, account"""


def account_order(spark, sf_dir: str) -> DataFrame:
    """Each property's rows in the order of a reader's alphabet, by provider, then account: case only decides between equals."""
    found = cells(bills(spark, sf_dir)).select("property", "provider", "account").distinct()
    named = found.withColumn("provider", F.when(F.col("account") % 2 == 0, F.upper("provider")).otherwise(F.lower("provider"))).withColumn("account", F.concat(F.lit("A"), F.lpad(F.col("account").cast("string"), 9, "0")))
    return ranked(named.select("property", "provider", "account"), ["property"], [F.collate("provider", "UNICODE"), F.collate("account", "UNICODE")], "place")


ACCOUNT_ORDER = f"""WITH {BILLS}, n AS (SELECT DISTINCT property, CASE WHEN account % 2 = 0 THEN upper(provider) ELSE lower(provider) END AS provider, 'A' || lpad(CAST(account AS VARCHAR), 9, '0') AS account FROM bills)
SELECT property, provider, account, CAST(row_number() OVER (PARTITION BY property ORDER BY lower(provider), provider DESC, account) AS INTEGER) AS place FROM n"""

QUERIES = {
    "utility_pivot": (utility_pivot, UTILITY_PIVOT),
    "account_order": (account_order, ACCOUNT_ORDER),
    "utility_cells": (utility_cells, UTILITY_CELLS),
    "utility_page_cells": (utility_page_cells, UTILITY_PAGE_CELLS),
    "utility_row_files": (utility_row_files, UTILITY_ROW_FILES),
    "utility_totals": (utility_totals, UTILITY_TOTALS),
    "utility_variance": (utility_variance, UTILITY_VARIANCE),
    "portfolio_rollup": (portfolio_rollup, PORTFOLIO_ROLLUP),
    "bill_month_bucket": (bill_month_bucket, BILL_MONTH_BUCKET),
    "bill_dates_set": (bill_dates_set, BILL_DATES_SET),
    "header_mode": (header_mode, HEADER_MODE),
}
