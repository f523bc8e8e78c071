"""Tables of a folder, and the carriers built on them: utility bills, bank statements, usage events, long-form fields.

Each carrier has its DuckDB twin beside it, as the common table expression that the queries' SQL starts from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bill page: file, page, seq (the order within the file), property, utility, provider, account, billing_date,
    and amount, taxes, other as decimals. The dimension tables are joined by key; Spark broadcasts them only below its own
    size limit."""
    t = lambda n: table(spark, sf_dir, n)
    # orders find their property first: they are fewer and narrower, and lineitem is then moved once, by the file
    files = (
        t("orders").select("o_orderkey", "o_custkey")
        .join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    joined = t("lineitem").join(files, F.col("l_orderkey") == F.col("o_orderkey")).join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.selectExpr(
        "l_orderkey AS file", "l_linenumber AS page", "struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS seq",
        "n_name AS property",
        "CASE WHEN l_returnflag = 'A' THEN 'Electric' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Water' WHEN l_returnflag = 'N' THEN 'Sewer' WHEN l_linestatus = 'O' THEN 'Gas' ELSE 'Trash' END AS utility",
        "s_name AS provider", "o_custkey AS account", "cast(l_shipdate AS date) AS billing_date",
        "cast(l_extendedprice AS decimal(18,2)) AS amount",
        "cast(cast(l_extendedprice AS decimal(18,2)) * cast(l_tax AS decimal(4,2)) AS decimal(22,4)) AS taxes",
        "cast(cast(l_extendedprice AS decimal(18,2)) * cast(l_discount AS decimal(4,2)) AS decimal(22,4)) AS other",
    )


BILLS = """bills AS (
  SELECT l_orderkey AS file, l_linenumber AS page, {'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_extendedprice, 'e': l_shipdate} AS seq, n_name AS property,
    CASE WHEN l_returnflag = 'A' THEN 'Electric' WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Water' WHEN l_returnflag = 'N' THEN 'Sewer' WHEN l_linestatus = 'O' THEN 'Gas' ELSE 'Trash' END AS utility,
    s_name AS provider, o_custkey AS account, CAST(l_shipdate AS DATE) AS billing_date,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(22,4)) AS taxes,
    CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(22,4)) AS other
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank movements: account, property, seq, day, kind (credit or debit), amount, and the account's beginning balance."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.selectExpr(
        "o_custkey AS account", "n_name AS property", "o_orderkey AS seq", "cast(o_orderdate AS date) AS day",
        "CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS kind",
        "cast(o_totalprice AS decimal(18,2)) AS amount", "cast(c_acctbal AS decimal(18,2)) AS beginning",
    )


TRANSACTIONS = """transactions AS (
  SELECT o_custkey AS account, n_name AS property, o_orderkey AS seq, CAST(o_orderdate AS DATE) AS day,
    CASE WHEN o_orderstatus = 'F' THEN 'credit' ELSE 'debit' END AS kind, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(c_acctbal AS DECIMAL(18,2)) AS beginning
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form fields: seq, file, page, field, value. A page is a user's day of events, a field an event type; one value in
    seven is blank, as when nothing was read."""
    e = table(spark, sf_dir, "events")
    return e.selectExpr(
        "event_id AS seq", "user_id AS file", "cast(date_diff(cast(ts AS date), date'2024-01-01') AS int) AS page", "event_type AS field",
        "CASE WHEN event_id % 7 = 0 THEN '' ELSE concat('v', cast(cast(value AS int) AS string)) END AS value",
    )


EXTRACTED = """extracted AS (
  SELECT event_id AS seq, user_id AS file, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS page, event_type AS field,
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'v' || CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) END AS value
  FROM events)"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage events: id, user_id, kind, amount, used_at, and the counters of the event's kind (null where they don't apply)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id", "event_type AS kind", "cast(value AS int) AS amount", "ts AS used_at",
        "CASE WHEN event_type = 'purchase' THEN 1 END AS files", "CASE WHEN event_type = 'view' THEN cast(value AS int) END AS pages", "CASE WHEN event_type = 'click' THEN 1 END AS downloads",
        "concat('doc', cast(get_json_object(props, '$.k') AS int) % 6) AS doc_type",
    )


USAGE = """usage AS (
  SELECT event_id AS id, user_id, event_type AS kind, CAST(trunc(value) AS INTEGER) AS amount, ts AS used_at,
    CASE WHEN event_type = 'purchase' THEN 1 END AS files, CASE WHEN event_type = 'view' THEN CAST(trunc(value) AS INTEGER) END AS pages, CASE WHEN event_type = 'click' THEN 1 END AS downloads,
    'doc' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 6 AS VARCHAR) AS doc_type
  FROM events)"""
