"""Exact dedup by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, Scratch, ascii_lower, or_empty, slot_filter, slot_of, slot_test, table

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, slots: int = SLOTS, digest_all: bool = False) -> DataFrame:
    """One row per row of docs: the id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is the empty text. Of equal texts the row with the
    largest id stays (a null id is below all others); of rows repeating that id too, one.

    Rounds: rows whose byte length no other row has are settled; then those whose (length, prefix hash) is alone; only
    what is left has its whole text hashed (SHA-256) and is grouped by it. The first two rounds run on a table of
    (id, length, prefix hash) and pass on fixed-size slot filters, so no text is shuffled, and a group of any size costs
    one partial aggregate per task. text_sha256 is null for rows settled early, unless digest_all asks for it.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(F.col(id_col).alias("_id"), or_empty(F.col(text_col)).alias("_text"))
    keyed = rows.select("_id", "_text", F.octet_length("_text").cast("long").alias("_len"), F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))).alias("_prefix"))
    keyed = keyed.withColumns({"_s1": slot_of(F.col("_len"), slots=slots), "_s2": slot_of(F.col("_len"), F.col("_prefix"), slots=slots)})

    slim = scratch.write(keyed.select("_s1", "_s2"))
    by_length = scratch.write(slot_filter(slim.groupBy(F.col("_s1").alias("slot")).count().filter("count > 1")))
    alive = slot_test(slim, "_s1", by_length, "_a1").filter("_a1")
    by_prefix = scratch.write(slot_filter(alive.groupBy(F.col("_s2").alias("slot")).count().filter("count > 1")))

    open_rows = slot_test(slot_test(keyed, "_s1", by_length, "_a1"), "_s2", by_prefix, "_a2")
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    hashed = open_rows.select(
        "_id", "_len", "_prefix", F.monotonically_increasing_id().alias("_row"), (F.col("_a1") & F.col("_a2")).alias("_open"),
        (digest if digest_all else F.when(F.col("_a1") & F.col("_a2"), digest)).alias("_sha"),
    )
    hashed = scratch.write(hashed)
    scratch.drop(slim, by_length, by_prefix)

    keys = ["_len", "_prefix", "_sha"]
    groups = hashed.filter("_open").groupBy(*keys).agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("_n")).filter("_n > 1")
    out = hashed.join(groups, keys, "left")
    alone = F.col("_n").isNull()
    return out.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
