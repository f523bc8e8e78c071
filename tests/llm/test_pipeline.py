import sys
from collections import Counter
from functools import reduce
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import messy  # noqa: E402
from test_dedup import LOWER, near_by_hand  # noqa: E402

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, stage, docs):
    return dict(corpus_pipeline.STAGES)[stage](spark, docs, "")


def documents(spark):
    return spark.createDataFrame([r[:5] for r in messy()], COLUMNS).repartition(3)


def test_stages(spark):
    docs = documents(spark)
    named = through(spark, "language_id", docs).cache()
    lost = {r.doc_id for r in docs.collect()} - {r.doc_id for r in named.collect()}
    assert lost == {4000, 4001, 4002} and named.columns == docs.columns
    once = through(spark, "exact_dedup", named).cache()
    texts = Counter((r.text or "").translate(LOWER) for r in once.collect())
    assert set(texts.values()) == {1} and set(texts) == {(r.text or "").translate(LOWER) for r in named.collect()}
    few = through(spark, "near_dedup", once).cache()
    want = near_by_hand([tuple(r) for r in once.collect()], 5)
    assert {r.doc_id for r in few.collect() if r.doc_id is not None} == {i for i, c in want.items() if i == c}
    mixed = through(spark, "mix_sources", few).cache()
    assert mixed.columns == docs.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    packed = through(spark, "pack", mixed).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in mixed.collect())


def test_language_stage_rejects_what_no_language_explains(spark):
    rows = [tuple(r) for r in documents(spark).collect()]
    junk = [(7000, " ".join("жλω#øþ"[k % 6 :] * 3 for k in range(60)), None, "s1", 0), (7001, "λόγος " * 40, "", "s1", 0)]
    kept = {r.doc_id for r in through(spark, "language_id", spark.createDataFrame(rows + junk[:1], COLUMNS)).collect()}
    assert 7000 not in kept and {4003, 4005, 4007, 5000} <= kept
    assert 7001 in {r.doc_id for r in through(spark, "language_id", spark.createDataFrame(rows + junk[1:], COLUMNS)).collect()}  # a learned value


def test_language_stage_keeps_even_mixtures(spark):
    words = {lang: ["".join(letters[(k * m + m) % len(letters)] for m in range(2, 7)) for k in range(40)] for lang, letters in (("x", "abcdefg"), ("y", "hijklmn"), ("z", "opqrstu"))}
    rows = [(n, " ".join(w[(n + k) % 40] for k in range(50)), lang, "s", 0) for n, (lang, w) in enumerate(words.items())]
    rows.append((9, " ".join(" ".join(w[:25]) for w in words.values()), None, "s", 0))
    found = through(spark, "language_id", spark.createDataFrame(rows, COLUMNS))
    assert sorted(r.doc_id for r in found.collect()) == [0, 1, 2, 9]


CLASHES = ["score", "lang_pred", "lang_mix", "language", "copies", "copies_", "each", "_slot", "_maybe", "_sha", "_row", "_id", "_text", "_copy", "_b", "_k", "_gone", "kept", "size", "LANGUAGE_", "Copies__"]


def test_stages_keep_clashing_columns(spark):
    docs = documents(spark)
    for c in CLASHES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))))
    for name in ("language_id", "exact_dedup", "near_dedup", "mix_sources"):
        docs = through(spark, name, docs).cache()
        assert docs.columns == [*documents(spark).columns, *CLASHES]
        bad = [F.col(f"`{c}`") != F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1))) for c in CLASHES]
        assert docs.count() and docs.filter(reduce(lambda a, b: a | b, bad)).count() == 0
    assert through(spark, "pack", docs).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_run_and_empty(spark, tmp_path):
    documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    (tmp_path / "none").mkdir()
    documents(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
