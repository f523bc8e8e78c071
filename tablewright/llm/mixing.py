"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, or_empty, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """sources (sk, source_size), one row per source, to (sk, source_size, target).

    Sources in order of sk take the weights in turn and share `share` times all sizes; a target stops at `cap` times its
    source's size, the excess going to the others by weight. That is water filling: with sources in order of
    cap / weight, all before the first whose cap exceeds weight * level are full. The windows run over one row per
    source, not over documents.
    """
    one = Window.partitionBy(F.lit(0)).orderBy("sk")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.row_number().over(one) - 1) % len(weights) + 1)
    s = sources.withColumn("w", w).withColumn("room", F.col("source_size") * cap)
    by_room = Window.partitionBy(F.lit(0)).orderBy(F.col("room") / F.col("w"), "sk")
    every = Window.partitionBy(F.lit(0))
    s = s.withColumns({"all_size": F.sum("source_size").over(every), "room_before": F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "w_left": F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("level", (F.col("all_size") * share - F.col("room_before")) / F.col("w_left"))
    s = s.withColumn("level", F.max(F.when(F.col("room") > F.col("w") * F.col("level"), F.col("level"))).over(every))
    target = F.when(F.col("level").isNull() | (F.col("room") <= F.col("w") * F.col("level")), F.col("room").cast("double")).otherwise(F.col("w") * F.col("level"))
    return s.select("sk", "source_size", target.alias("target"))


def offset(sk: Column, seed: str) -> Column:
    """The source's random offset in [0, 1), in steps of 2**-16, so that rank * e + offset keeps its last bit up to 10**10 documents."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), sk)), 1, 4), 16, 10).cast("double") / 65536


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = "mix", carry: str | None = None) -> DataFrame:
    """One row per row of docs: the id, size, source_size, target, copies, taken; with carry, all columns of docs and the copies in a
    column of the name given (in place of one that docs has). An empty table gives no rows.

    A document's size is its number of words (null text: 0). Each of a source's documents is expected target /
    source_size times. In order of (size, md5 of the id, id), the running sum of expected copies plus the source's one
    offset is cut at the integers: a document is emitted once per integer crossed, so copies differ by at most one
    within a source, and neighbours in size share the rounding, which keeps the taken words near the target. Ordering by
    md5 makes reruns agree. Sources go by code point, null last; a source of size 0 gets target 0. Rows repeating an id
    are separate documents whose copies may be exchanged.

    The running rank isn't one window per source: it adds the counts of smaller sizes (a histogram per source), of
    smaller md5 bytes within the size, and a row number within (source, size, md5 byte), so a source or a size with a third of
    all rows is dealt over 256 tasks.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    text, source, doc_id = or_empty(F.col(text_col)), F.col(source_col).cast("string"), F.col(id_col)
    keys = [F.concat(F.when(source.isNull(), "1").otherwise("0"), or_empty(source)).alias("_sk"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), F.md5(or_empty(doc_id.cast("string"))).alias("_md"), doc_id.alias("_id")]
    sized = docs.select(*keys, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else [])).withColumn("_b", F.substring("_md", 1, 2))
    if not carry:
        sized = scratch.write(sized)

    cells = scratch.write(sized.groupBy("_sk", "_size", "_b").agg(F.count("*").alias("n")))
    sizes = cells.groupBy("_sk", "_size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.groupBy(F.col("_sk").alias("sk")).agg(F.sum(F.col("_size") * F.col("n")).alias("source_size")), weights, share, cap).withColumnRenamed("sk", "_sk")
    before = lambda *part: F.coalesce(F.sum("n").over(Window.partitionBy(*part[:-1]).orderBy(part[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("p1", before("_sk", "_size")).drop("n").join(targets, "_sk")
    cells = cells.withColumn("p2", before("_sk", "_size", "_b")).drop("n").join(sizes, ["_sk", "_size"]).withColumn("before", F.col("p1") + F.col("p2")).drop("p1", "p2")

    ranked = sized.withColumn("_rank", F.row_number().over(Window.partitionBy("_sk", "_size", "_b").orderBy("_md", "_id")))
    out = ranked.join(cells, ["_sk", "_size", "_b"]).withColumn("_k", F.col("_rank") + F.col("before"))
    e, u = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), offset(F.col("_sk"), seed)
    copies = F.least(F.floor(e * F.col("_k") + u) - F.floor(e * (F.col("_k") - 1) + u), F.lit(cap)).cast("long")
    if carry:
        return out.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c != carry], copies.alias(carry))
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("copies")


MIX_CTES = """sized AS (
  SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS sk, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS md FROM {docs}),
src AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY sk),
weighed AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY sk) - 1) % 3 + 1] AS w, source_size * 2 AS room FROM src),
filled AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(room) OVER (ORDER BY room / w, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / CAST(sum(w) OVER (ORDER BY room / w, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lv FROM weighed),
levelled AS (SELECT *, max(CASE WHEN room > w * lv THEN lv END) OVER () AS level FROM filled),
targets AS (SELECT sk, source_size, CASE WHEN level IS NULL OR room <= w * level THEN CAST(room AS DOUBLE) ELSE w * level END AS target FROM levelled),
ranked AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e, CAST(concat('0x', substr(md5('mix' || s.sk), 1, 4)) AS INTEGER) / 65536.0::DOUBLE AS u, row_number() OVER (PARTITION BY s.sk ORDER BY size, md, doc_id) AS k FROM sized s JOIN targets t USING (sk)),
mixed AS (SELECT *, least(CAST(floor(e * k + u) - floor(e * (k - 1) + u) AS BIGINT), 2) AS copies FROM ranked)"""

ORACLE = f"WITH {MIX_CTES.format(docs='documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"
