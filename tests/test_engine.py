import io
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tablewright import queries as engine
from tablewright.operators.eav import edit, first_wins, fold, unfold, vote
from tablewright.operators.geometry import REGIONS, words_in_rect
from tablewright.operators.linkage import community, star_groups
from tablewright.operators.page_folds import lines_of, merged_boxes, merged_cells
from tablewright.plans.bank import spine
from tablewright.plans.utility import month_key
from tablewright.operators.ranks import ranked
from tablewright.sources import xlsx
from tablewright.streaming.usage_stream import current, slot_sink, usage_windows, versions


def test_names_match():
    assert set(engine.oracle_sql()) <= set(engine.queries())
    assert len(engine.queries()) >= 60
    assert set(engine.queries()) <= set(__spark_entry__.queries())


def test_month_key(spark):
    rows = spark.createDataFrame([(date(2025, 1, 14),), (date(2025, 1, 15),)], "d date")
    assert [tuple(r) for r in rows.select(month_key(F.col("d")), month_key(F.col("d"), False)).collect()] == [("2024-12", "2025-01"), ("2025-01", "2025-01")]


@pytest.mark.parametrize(("earliest", "n", "first"), [(None, 12, "2024-12-31"), (date(2024, 6, 15), 18, "2024-06-30"), (date(2025, 4, 10), 12, "2024-12-31")])
def test_spine(spark, earliest, n, first):
    got = spark.range(1).select(spine(F.lit(date(2025, 11, 30)), F.lit(earliest).cast("date"))).first()[0]
    assert (len(got), str(got[0]), str(got[-1])) == (n, first, "2025-11-30")


def eav(spark, rows):
    return spark.createDataFrame(rows, "seq long, file string, page int, field string, value string")


def test_eav(spark):
    rows = eav(spark, [(0, "f", 1, "a", ""), (1, "f", 1, "a", "x"), (2, "f", 1, "a", "y"), (3, "f", 1, "b", "z")])
    assert first_wins(rows, ["file"], ["a", "b"]).collect()[0].asDict() == {"file": "f", "a": "x", "b": "z"}
    folded = fold(rows, ["file", "page"])
    assert folded.first()["fields"] == {"a": ", x, y", "b": "z"}
    assert unfold(folded).count() == 2
    edits = spark.createDataFrame([("f", 1, "a", 2, "Y"), ("f", 1, "c", 0, "new")], "file string, page int, field string, occ int, new_value string")
    got = {(r.field, r.occ): (r.value, r.edited) for r in edit(rows, edits, ["file", "page"]).collect()}
    assert got[("a", 2)] == ("Y", True) and got[("c", 0)] == ("new", True) and got[("b", 0)] == ("z", False)
    assert vote(rows, ["file"], {"b": "lease"}, "bill").first()["doc_type"] == "lease"


def test_words_in_rect_glues(spark):
    words = spark.createDataFrame([("d", 1, "12", 0.0, 0.0, 12.0, 10.0), ("d", 1, "34", 12.5, 0.0, 24.0, 10.0), ("d", 1, "x", 40.0, 0.0, 46.0, 10.0)], "doc string, page int, text string, x0 double, y0 double, x1 double, y1 double")
    rects = spark.createDataFrame([REGIONS[0]], "region int, page int, a0 double, b0 double, a1 double, b1 double")
    assert words_in_rect(words, rects).first()["text"] == "1234 x"


class Box:
    def __init__(self, **k):
        self.__dict__.update(k)


def test_page_folds():
    boxes = [Box(x0=0, y0=0, x1=1, y1=1), Box(x0=5, y0=5, x1=6, y1=6), Box(x0=1.005, y0=0, x1=2, y1=1)]
    assert merged_boxes(boxes) == [(0, 0.0, 0.0, 2.0, 1.0), (1, 5.0, 5.0, 6.0, 6.0)]
    seg = [Box(orient="h", lo=0, hi=100, axis=y) for y in (0, 50, 100)] + [Box(orient="v", lo=0, hi=100, axis=x) for x in (0, 100)] + [Box(orient="v", lo=50, hi=100, axis=50)]
    assert [c[:4] for c in merged_cells(seg)] == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    words = [Box(text="b", x0=10, x1=15, y0=1, y1=11), Box(text="a", x0=0, x1=5, y0=0, y1=10), Box(text="c", x0=0, x1=5, y0=20, y1=30)]
    assert [r[-1] for r in lines_of(words)] == ["a b", "c"]


def test_star_groups_are_not_transitive(spark):
    found = spark.createDataFrame([("k", "a", "b", 0, 1), ("k", "b", "c", 1, 2)], "field string, a string, b string, sa long, sb long")
    assert star_groups(found.limit(0), ["field"]).count() == 0
    assert sorted((r.seed, r.value) for r in star_groups(found, ["field"]).collect()) == [("a", "a"), ("a", "b")]


def test_community(spark):
    rows = spark.createDataFrame([("batch/Agave Village/shot.png",), ("shot.png",)], "p string")
    assert [r[0] for r in rows.select(community(F.col("p"))).collect()] == ["Agave Village", "(root)"]


def test_workbook_round_trip(spark, tmp_path):
    rows = [["Account No.", "Charges & fees", "n"], ["A<1>", None, 12.5], ["B", "", 3]]
    data = xlsx.workbook({"Plain/Data": rows, "plain data": []})
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    (tmp_path / "a.xlsx").write_bytes(data)
    cells = xlsx.read_workbooks(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {(r.row, r.col): r.text for r in cells.collect()}
    assert got == {(1, 0): "Account No.", (1, 1): "Charges & fees", (1, 2): "n", (2, 0): "A<1>", (2, 2): "12.5", (3, 0): "B", (3, 2): "3"}
    assert xlsx.header_row(cells).first()["header"] == 1
    spark.dataSource.register(xlsx.XlsxSource)
    assert spark.read.format("tablewright_xlsx").load(str(tmp_path / "a.xlsx")).count() == 7
    assert xlsx.sheet_names(["a/b", "A b", "x" * 40]) == ["a b", "A b (2)", "x" * 31]


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "doc string, slot int, value string, seq long"
    spark.createDataFrame([("d", 1, "b", 0), ("d", 0, "a", 1)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    for _ in range(2):
        q = stream.writeStream.foreachBatch(slot_sink(out, ["doc", "slot"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.createDataFrame([("d", 1, "B", 2), ("d", 2, "c", 3)], schema).write.mode("append").parquet(src)
    assert {r.slot: r.value for r in current(spark, out).collect()} == {0: "a", 1: "B", 2: "c"}
    merge = slot_sink(out, ["doc", "slot"])
    for batch_id in (5, 6, 7, 6):  # an older answer that comes late, again and again, and a replay
        merge(spark.createDataFrame([("d", 1, "OLD", 0), ("d", 3, f"new{batch_id}", batch_id)], schema), batch_id)
    assert {r.slot: r.value for r in current(spark, out).collect()} == {0: "a", 1: "B", 2: "c", 3: "new7"}
    assert versions(spark, out) == [6, 7]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "view", 2), ("2024-01-01 00:50:00", "view", 3)], "used_at string, kind string, amount int")
    assert usage_windows(events).first()["amount"] == 5


def test_ranks_by_hand(spark):
    """Places over more partitions than one, a group that fills several, nulls, ties broken by the order's last key."""
    rows = [("hot" if i % 3 else (None if i % 2 else "cold"), (i * 7919) % 50, i) for i in range(400)]
    out = ranked(spark.createDataFrame(rows, "g string, v int, i int"), ["g"], [F.desc("v"), F.asc("i")], "place", parts=9)
    want = []
    for g in {r[0] for r in rows}:
        want += [(*r, k) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
