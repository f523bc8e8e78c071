"""From documents to packed training sequences: each stage calls one operator on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import language_id, mixing, near_dedup, packing
from tablewright.llm.common import Scratch, ascii_lower, fresh, or_empty, packed, slot_filter, slot_of, slot_test, table, without_ids
from tablewright.llm.exact_dedup import exact_dedup

#: Least share of a document that the learned languages must explain, beside a background of no language. Random letters and other
#: scripts have less than 0.1; a few words around long numbers and keys, which stay, 0.5 and more.
KNOWN = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents' own language marks; rejects documents without a letter and those that no mixture of the
    learned languages explains; a text in several of them stays, however even its shares.
    Without any mark nothing can be learned, and only documents without a letter go. Null and empty texts have no letter;
    repeated rows stay or go together; other columns come out as they went in, whatever their names."""
    model = language_id.learn(docs)
    if not model.names:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    into = fresh("language", docs.columns)
    found = language_id.identify(docs, model, into=into)
    return found.filter((F.col(f"{into}.lang_pred") != language_id.UNKNOWN) & (F.col(f"{into}.known") >= KNOWN)).drop(into)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat id and text, one. Null is the empty text. An empty
    table stays empty; other columns come out as they went in, whatever their names."""
    scratch = Scratch(spark, "copies")
    verdict = scratch.write(exact_dedup(docs).filter("group_size > 1").select("doc_id", "text_sha256", "kept"))
    touched = slot_filter(verdict.filter("not kept").select(slot_of(F.col("doc_id")).alias("slot")))
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"), packed(docs))
    marked = slot_test(rows.withColumn("_slot", slot_of(F.col("_id"))), "_slot", touched, "_maybe")
    sure = marked.filter("not _maybe").select("_row.*")
    maybe = marked.filter("_maybe").withColumn("_sha", F.sha2(ascii_lower(or_empty(F.col("_text"))), 256))
    by_row = verdict.groupBy(F.col("doc_id").alias("_vid"), F.col("text_sha256").alias("_vsha")).agg(F.max("kept").alias("_kept"), (F.count("*") > 1).alias("_again"))
    judged = maybe.join(by_row, F.col("_id").eqNullSafe(F.col("_vid")) & (F.col("_sha") == F.col("_vsha")), "left").filter(F.coalesce("_kept", F.lit(True)))
    once = judged.filter(~F.coalesce("_again", F.lit(False))).select("_row.*")
    repeats = judged.filter("_again").dropDuplicates(["_id", "_sha"]).select("_row.*")
    return sure.unionAll(once).unionAll(repeats)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more: of each group of documents that links connect, the one with the least id stays. Null and
    empty texts stay; rows that repeat an id stay or go together, rows without an id stay unless their text equals one with an
    id. An empty table stays empty; other columns come out as they went in, whatever their names."""
    verdict = near_dedup.near_duplicates(docs)
    gone = Scratch(spark, "gone").write(verdict.filter("not kept").select("doc_id").distinct())
    return without_ids(docs, "doc_id", gone)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as many times (0, 1 or 2) as the sampling emits it. Texts without a word
    have size 0 and come as their place in the order has it; a null source is a source. An empty table stays empty; other columns
    come out as they went in, whatever their names."""
    copies, each = fresh("copies", docs.columns), fresh("each", docs.columns)
    mixed = mixing.mix_sources(docs, carry=copies)
    return mixed.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(copies).cast("int")))).drop(copies, each)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null and empty texts are one piece of one token; rows that come twice are packed twice. An empty table gives no rows;
    other columns are not read."""
    return packing.pack_documents(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("pack", pack),
]

#: Language identification isn't expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
