"""Usage dashboard. Whatever depends on the clock takes `now`."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..sources.tables import USAGE, table, usage

NOW = datetime(2024, 1, 20, 12)


def in_range(rows: DataFrame, which: str, now: datetime = NOW, column: str = "used_at") -> DataFrame:
    """Rows of the last 24 hours ('today') or 7 days ('week'), or all; without a time only in 'all'."""
    if which == "all":
        return rows
    hours = {"today": 24, "week": 24 * 7}[which]
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {hours} hours")
    return rows.filter((F.col(column) >= since) & (F.col(column) <= F.lit(now).cast("timestamp_ntz")))


def totals(rows: DataFrame) -> DataFrame:
    """Missing counters count as zero; a batch is an event with files."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.agg(F.countDistinct("user_id").alias("users"), F.count_if(F.col("files") > 0).alias("batches"), n("files"), n("pages"), n("downloads"))


def by_user(rows: DataFrame) -> DataFrame:
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return rows.groupBy("user_id").agg(F.count_if(F.col("files") > 0).alias("batches"), n("files"), n("pages"), n("downloads"), F.max("used_at").alias("last_active"), F.max_by("kind", F.struct("used_at", "id")).alias("last_kind"))


def top(rows: DataFrame, partition: list[str], by: str, tie: str, k: int = 5) -> DataFrame:
    """The k rows with the greatest `by` in each partition, ties by the least `tie`."""
    w = Window.partitionBy(*partition).orderBy(F.desc(by), tie)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def usage_totals(spark, sf_dir: str) -> DataFrame:
    return totals(usage(spark, sf_dir))


USAGE_TOTALS = f"WITH {USAGE} SELECT count(DISTINCT user_id) AS users, count(*) FILTER (files > 0) AS batches, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(downloads), 0) AS BIGINT) AS downloads FROM usage"


def usage_by_user(spark, sf_dir: str) -> DataFrame:
    return by_user(usage(spark, sf_dir))


USAGE_BY_USER = f"""WITH {USAGE} SELECT user_id, count(*) FILTER (files > 0) AS batches, CAST(coalesce(sum(files), 0) AS BIGINT) AS files, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, CAST(coalesce(sum(downloads), 0) AS BIGINT) AS downloads,
  max(used_at) AS last_active, arg_max(kind, {{'t': used_at, 'i': id}}) AS last_kind FROM usage GROUP BY user_id"""


def usage_doc_types(spark, sf_dir: str) -> DataFrame:
    """How many events name each document type, and by how many users, from each user's list of types."""
    lists = usage(spark, sf_dir).groupBy("user_id").agg(F.collect_list("doc_type").alias("doc_types"))
    return lists.select("user_id", F.explode("doc_types").alias("doc_type")).groupBy("doc_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


USAGE_DOC_TYPES = f"WITH {USAGE} SELECT doc_type, count(*) AS n, count(DISTINCT user_id) AS users FROM usage GROUP BY doc_type"


def usage_top5(spark, sf_dir: str) -> DataFrame:
    """Top-5 users of each kind by amount."""
    sums = usage(spark, sf_dir).groupBy("kind", "user_id").agg(F.sum("amount").alias("amount"))
    return top(sums, ["kind"], "amount", "user_id")


USAGE_TOP5 = f"WITH {USAGE}, s AS (SELECT kind, user_id, CAST(sum(amount) AS BIGINT) AS amount FROM usage GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY amount DESC, user_id) AS INTEGER) AS place FROM s) WHERE place <= 5"


def usage_range(spark, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir)
    parts = [in_range(rows, w).groupBy("kind").agg(F.count("*").alias("n")).withColumn("range", F.lit(w)) for w in ("today", "week", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


USAGE_RANGE = f"""WITH {USAGE} SELECT kind, count(*) AS n, r AS "range" FROM usage, (VALUES ('today', 24), ('week', 168), ('all', 1000000)) v(r, h)
WHERE r = 'all' OR (used_at >= TIMESTAMP '2024-01-20 12:00:00' - to_hours(h) AND used_at <= TIMESTAMP '2024-01-20 12:00:00') GROUP BY kind, r"""


def usage_search(spark, sf_dir: str) -> DataFrame:
    """Events whose user, kind or type contains '1E' or 'SIGN', whatever the case; the seven sort keys go with them."""
    rows = usage(spark, sf_dir).withColumn("username", F.concat(F.lit("User"), F.col("user_id").cast("string"), F.lit("e")))
    hit = F.lit(False)
    for q in ("1E", "SIGN"):
        for c in ("username", "kind", "doc_type"):
            hit = hit | F.contains(F.lower(c), F.lit(q.lower()))
    return rows.filter(hit).select("id", "username", "kind", "doc_type")


USAGE_SEARCH = f"WITH {USAGE}, u AS (SELECT *, 'User' || user_id || 'e' AS username FROM usage) SELECT id, username, kind, doc_type FROM u WHERE contains(lower(username), '1e') OR contains(lower(kind), '1e') OR contains(lower(doc_type), '1e') OR contains(lower(username), 'sign') OR contains(lower(kind), 'sign') OR contains(lower(doc_type), 'sign')"

def timestamp(iso: Column, now: Column, zone: str) -> Column:
    """An ISO time as an instant: with an offset, that; without, UTC, unless that is more than two hours ahead of now: then it is local time in the
    zone. Null if it is no time."""
    naive = F.replace(iso, F.lit("T"), F.lit(" "))
    utc = F.try_to_timestamp(F.concat(naive, F.lit("+00:00")))
    local = F.to_utc_timestamp(F.try_to_timestamp(F.concat(naive, F.lit("+00:00"))), zone)
    return F.when(iso.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(iso)).otherwise(F.when(utc > now + F.expr("interval 2 hours"), local).otherwise(utc))


def duration_label(seconds: Column) -> Column:
    """4.6 s, 1m 12s, 1h 5m; a dash for none or a negative one."""
    s = F.round(seconds).cast("long")
    minutes = F.concat(F.expr("0") + F.floor(s / 60), F.lit("m "), s % 60, F.lit("s"))
    hours = F.concat(F.floor(s / 3600), F.lit("h "), F.floor(s / 60) % 60, F.lit("m"))
    return F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "\u2014").when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit(" s"))).when(s < 3600, minutes).otherwise(hours)


def age_label(then: Column, now: Column) -> Column:
    """just now, 5m ago, 3h ago, 2d ago; beyond a week the day."""
    rounded = lambda x: F.floor(x + 0.5).cast("long")
    minutes = rounded((F.unix_micros(now) - F.unix_micros(then)) / 60e6)
    hours = rounded(minutes / 60)
    days = rounded(hours / 24)
    return F.when(minutes < 1, "just now").when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 24, F.concat(hours, F.lit("h ago"))).when(days < 7, F.concat(days, F.lit("d ago"))).otherwise(F.date_format(then, "MMM d"))


def usage_times(spark, sf_dir: str) -> DataFrame:
    """Events' times as clients write them: in UTC with Z or bare, six hours ahead with an offset, or six hours ahead and bare; seen from NOW."""
    e = table(spark, sf_dir, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp_ntz").cast("timestamp")))
    iso, ahead = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.col("t") + F.expr("interval 6 hours"), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(iso, F.lit("Z"))).when(k == 1, iso).when(k == 2, F.concat(ahead, F.lit("+06:00"))).otherwise(ahead)
    now = F.lit(NOW).cast("timestamp_ntz").cast("timestamp")
    at = timestamp(raw, now, "Asia/Dhaka")
    seconds = (F.floor("value") * 10 * F.when(k == 3, -1).otherwise(F.col("event_id") % 97) + F.col("event_id") % 10) / 10.0
    return e.select(F.col("event_id").alias("id"), F.unix_seconds(at).alias("at"), age_label(at, now).alias("age"), duration_label(seconds).alias("took"))


USAGE_TIMES = """WITH e AS (SELECT event_id AS id, event_id % 4 AS k, date_trunc('second', CAST(ts AS TIMESTAMP)) AS t, TIMESTAMP '2024-01-20 12:00:00' AS now, (floor(value) * 10 * CASE WHEN event_id % 4 = 3 THEN -1 ELSE event_id % 97 END + event_id % 10) / 10.0::DOUBLE AS s FROM events),
a AS (SELECT *, CASE WHEN k = 3 AND t + INTERVAL 6 HOUR <= now + INTERVAL 2 HOUR THEN t + INTERVAL 6 HOUR WHEN k = 1 AND t > now + INTERVAL 2 HOUR THEN t - INTERVAL 6 HOUR ELSE t END AS inst FROM e),
m AS (SELECT *, floor((epoch_us(now) - epoch_us(inst)) / 60000000.0::DOUBLE + 0.5::DOUBLE) AS mi, CAST(round(s) AS BIGINT) AS r FROM a), h AS (SELECT *, floor(mi / 60 + 0.5::DOUBLE) AS ho FROM m), d AS (SELECT *, floor(ho / 24 + 0.5::DOUBLE) AS da FROM h)
SELECT id, CAST(epoch(inst) AS BIGINT) AS "at", CASE WHEN mi < 1 THEN 'just now' WHEN mi < 60 THEN CAST(mi AS BIGINT) || 'm ago' WHEN ho < 24 THEN CAST(ho AS BIGINT) || 'h ago' WHEN da < 7 THEN CAST(da AS BIGINT) || 'd ago' ELSE strftime(inst, '%b %-d') END AS age,
  CASE WHEN s < 0 THEN chr(8212) WHEN s < 60 THEN printf('%.1f', s) || ' s' WHEN r < 3600 THEN (r // 60) || 'm ' || (r % 60) || 's' ELSE (r // 3600) || 'h ' || (r // 60 % 60) || 'm' END AS took FROM d"""

# What users can be sorted by.
SORT_KEYS = ("files", "extracted", "pages_extracted", "downloads", "ocr_downloads", "table_extracts", "last_active")


def usage_sorted(spark, sf_dir: str) -> DataFrame:
    """Each user's place by each of the seven keys, the greatest first, ties by user."""
    kinds = {"files": "purchase", "downloads": "click", "ocr_downloads": "signup", "table_extracts": "error"}
    rows = usage(spark, sf_dir)
    sums = [F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()]
    users = rows.groupBy("user_id").agg(*sums, F.count("*").alias("extracted"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages_extracted"), F.max("used_at").alias("last_active"))
    long = users.select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), (F.unix_micros(F.col(k).cast("timestamp")) if k == "last_active" else F.col(k).cast("long")).alias("value")) for k in SORT_KEYS])).alias("x"))
    return ranked(long.select("x.key", "user_id", "x.value"), ["key"], [F.desc("value"), F.asc("user_id")], "place")


USAGE_SORTED = f"""WITH {USAGE}, u AS (SELECT user_id, count(*) FILTER (kind = 'purchase') AS files, count(*) AS extracted, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages_extracted, count(*) FILTER (kind = 'click') AS downloads,
  count(*) FILTER (kind = 'signup') AS ocr_downloads, count(*) FILTER (kind = 'error') AS table_extracts, epoch_us(CAST(max(used_at) AS TIMESTAMP)) AS last_active FROM usage GROUP BY user_id),
l AS ({' UNION ALL '.join(f"SELECT '{k}' AS key, user_id, CAST({k} AS BIGINT) AS value FROM u" for k in SORT_KEYS)})
SELECT key, user_id, value, CAST(row_number() OVER (PARTITION BY key ORDER BY value DESC, user_id) AS INTEGER) AS place FROM l"""

QUERIES = {
    "usage_times": (usage_times, USAGE_TIMES),
    "usage_sorted": (usage_sorted, USAGE_SORTED),
    "usage_totals": (usage_totals, USAGE_TOTALS),
    "usage_by_user": (usage_by_user, USAGE_BY_USER),
    "usage_doc_types": (usage_doc_types, USAGE_DOC_TYPES),
    "usage_top5": (usage_top5, USAGE_TOP5),
    "usage_range": (usage_range, USAGE_RANGE),
    "usage_search": (usage_search, USAGE_SEARCH),
}
