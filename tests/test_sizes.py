"""Results that must not depend on how large a table is, or how it is cut."""

import duckdb
from pyspark.sql import functions as F

from tablewright.functions.text import SLICE, search_key
from tablewright.operators import extraction, geometry, linkage, page_sources
from tablewright.operators.pages import combined, joined_texts, per_page


def test_similar_pairs_meet_over_the_whole_table(spark, tmp_path):
    """Names of one brand meet however far apart their parts are."""
    rows = [(5, "green valve", "Brand#1"), (900_000, "green valves", "Brand#1"), (7, "green valve", "Brand#2"), (2_000, "red pump", "Brand#2")]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in linkage.similar_pairs(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    assert got == set(db.sql(linkage.SIMILAR_PAIRS).fetchall()) == {("Brand#1", "green valve", "green valves", 1)}


def test_pages_longer_than_a_batch(spark):
    """A page that several Arrow batches share is one page, to per_page and to joined_texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(d, 1, i % 3, float(-i), f"t{i}") for d in range(5) for i in range(d * 9)] + [(9, 1, 0, 0.0, None), (9, 1, 0, 1.0, "x")]
        words = spark.createDataFrame(rows, "doc long, page int, row int, x0 double, text string")
        assert {(r.doc, r.n) for r in per_page(words, lambda page: [(len(page),)], "n int").collect()} == {(1, 9), (2, 18), (3, 27), (4, 36), (9, 2)}
        got = {(r.doc, r.row): r.text for r in joined_texts(words, ["doc", "page", "row"], ["x0"]).collect()}
        want = {(d, k): [r for r in rows if (r[0], r[2]) == (d, k)] for d, k in {(r[0], r[2]) for r in rows}}
        assert got == {k: " ".join(r[4] for r in sorted(of, key=lambda r: r[3]) if r[4]) for k, of in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_over_several_slices(spark):
    texts = [(i, f"  Ünï {i % 300}  Text. ") for i in range(2 * SLICE + 3)] + [(-1, None)]
    got = {r.i: r.k for r in spark.createDataFrame([t for t in texts if t[1]], "i long, t string").coalesce(1).select("i", search_key(F.col("t")).alias("k")).collect()}
    assert got == {i: f"uni {i % 300} text" for i, t in texts if t}


def test_best_grid_of_any_number_of_slots(spark):
    """Grids of more slots than a long has bits; a page is one row before it is moved, however many words it has."""
    lines = list(range(10, 1000, 10))
    grids = [([50], [50]), (lines, lines), (lines, [5000])]
    spots = [(d, x, y) for d in range(4) for x, y in ((k * 37 * (d + 1) % 1100, k * 53 % 1300) for k in range(d * 40 + 1))]
    words = spark.createDataFrame([(d, 1, float(x), float(y), float(x), float(y)) for d, x, y in spots], "doc long, page int, x0 double, y0 double, x1 double, y1 double")
    out = geometry.best_grid(words, grids)
    want = {}
    for d in range(4):
        for i, (cols, rows) in enumerate(grids):
            slots = {(sum(r <= y for r in rows), sum(c <= x for c in cols)) for k, x, y in spots if k == d}
            n, r, c = len(slots), len({a for a, _ in slots}), len({b for _, b in slots})
            score = round(n * 0.1 if r < 2 or c < 2 else n * (1 + min(r, c) / max(r, c)), 6)
            want[d] = max(want.get(d, (-1.0, 0)), (score, -i))
    assert {r.doc: (r.score, -r.candidate) for r in out.collect()} == want
    moved = geometry.best_grid(words, grids)._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning")
    assert len(moved) == 2 and "HashAggregate" in moved[1]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_preference_sorts_each_document_once(spark):
    """Candidates and tables of a document are gathered together, not joined; those without a document have no table."""
    c = spark.createDataFrame([(1, 5, 1.0, 1.0), (1, 6, 9.0, 9.0), (2, 1, 1.0, 1.0), (3, 2, 1.0, None), (3, 4, 2.0, 2.0), (None, 1, 1.0, 1.0), (None, 2, 9.0, 9.0)], "doc long, seq int, x double, y double")
    t = spark.createDataFrame([(d, 8.0, 8.0, 10.0, 10.0) for d in (1, 2, 4, None)], "doc long, t_x0 double, t_y0 double, t_x1 double, t_y1 double")
    got = [{r.doc: r.seq for r in extraction.prefer_in_table(c, t, only).collect()} for only in (False, True)]
    assert got == [{1: 6, 2: 1, 3: 2, None: 1}, {1: 6, 2: None, 3: None, None: None}]
    assert "Join" not in _plan(extraction.prefer_in_table(c, t))


def test_word_sources_move_a_row_for_a_page(spark, tmp_path):
    """Words are counted where they are laid out: the joins that choose read what was written, a row for each page and source."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, 1, 0, 3, 4.0, "b"), (1, 1, 1, 1, 2.0, "z"), (None, 1, 0, 1, 1.0, None), (1, None, 0, 1, 1.0, "y"), (1, None, 0, 2, 1.0, "x")] * 9
        got = combined(spark.createDataFrame(rows, "doc long, page int, read int, n long, x0 double, text string"), ["doc", "page", "read"], {"n": "sum", "x0": "max", "text": "min"})
        assert {tuple(r) for r in got.collect()} == {(1, 1, 0, 27, 4.0, "b"), (1, 1, 1, 9, 2.0, "z"), (None, 1, 0, 9, 1.0, None), (1, None, 0, 27, 1.0, "x")}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    texts = [(d, "\n".join(" ".join(f"w{d * i * j % 11}" for j in range(d)) for i in range(60))) for d in range(1, 16)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = page_sources.word_sources(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {tuple(r) for r in out.collect()} == set(db.sql(page_sources.WORD_SOURCES).fetchall())
    assert "Generate" not in _plan(out)
