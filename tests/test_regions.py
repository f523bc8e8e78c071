"""Region tables: the cascade against plain loops over random pages, and hand-made pages for each finder."""

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tablewright.operators.geometry import row_boxes, row_islands
from tablewright.operators.page_folds import aligned_tables, bordered, fixpoint, page_tables
from tablewright.operators.region_tables import channels, region_columns, region_tables, selected_columns

WORDS = "doc long, page int, x0 double, y0 double, x1 double, y1 double, text string"
SEGMENTS = "doc long, page int, orient string, lo double, hi double, axis double"
REGIONS = "doc long, page int, region int, a0 double, b0 double, a1 double, b1 double"


def word(doc, x, y, text):
    return (doc, 1, float(x), float(y), float(x + 6 * len(text)), float(y + 10), text)


def ruled(doc, xs, ys, skip=()):
    h = [(doc, 1, "h", float(xs[i]), float(xs[i + 1]), float(y)) for y in ys for i in range(len(xs) - 1) if ("h", i, y) not in skip]
    return h + [(doc, 1, "v", float(ys[j]), float(ys[j + 1]), float(x)) for x in xs for j in range(len(ys) - 1) if ("v", x, j) not in skip]


def found(spark, words, segments, regions):
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    out = {}
    for r in region_tables(df(words, WORDS), df(segments, SEGMENTS), df(regions, REGIONS)).collect():
        out.setdefault((r.doc, r.region), (r.source, round(r.score, 6), r.n_rows, r.n_cols, []))[4].append((r.row, r.col, r.rowspan, r.colspan, r.text))
    return {k: (*v[:4], sorted(v[4])) for k, v in out.items()}


def test_each_finder(spark):
    xs, ys = [0, 100, 200, 300], [0, 20, 40, 60]
    table = [word(1, 10, 5, "Name"), word(1, 110, 5, "both"), word(1, 140, 5, "cells"), word(1, 10, 25, "a"), word(1, 110, 25, "1"), word(1, 210, 25, "2"), word(1, 10, 45, "b"), word(1, 20, 52, "c")]
    # doc 1: a wall is missing in the first row; doc 2: a frame only; doc 3: no lines at all; doc 4: lines, no words
    words = table + [(2, *w[1:]) for w in table] + [(3, *w[1:]) for w in table]
    frame = [(2, 1, "h", 0.0, 300.0, 0.0), (2, 1, "h", 0.0, 300.0, 60.0), (2, 1, "v", 0.0, 60.0, 0.0), (2, 1, "v", 0.0, 60.0, 300.0)]
    segments = ruled(1, xs, ys, skip={("v", 200, 0)}) + frame + ruled(4, xs, ys)
    all_ = [(d, 1, 0, -1.0, -1.0, 301.0, 61.0) for d in (1, 2, 3, 4)]
    got = found(spark, words, segments, [*all_, (1, 1, 1, 105.0, 21.0, 299.0, 39.0), (1, 1, 2, 400.0, 0.0, 500.0, 50.0), (9, 1, 0, 0.0, 0.0, 9.0, 9.0)])
    assert got[1, 0] == ("geometry", 12.0, 3, 3, [(0, 0, 1, 1, "Name"), (0, 1, 1, 2, "both cells"), (1, 0, 1, 1, "a"), (1, 1, 1, 1, "1"), (1, 2, 1, 1, "2"), (2, 0, 1, 1, "b\nc"), (2, 1, 1, 1, ""), (2, 2, 1, 1, "")])
    # the frame's grid has one cell, so the words' own grid is better; both documents have the same
    assert got[2, 0][0] == got[3, 0][0] == "words" and got[2, 0][1:] == got[3, 0][1:]
    assert got[3, 0][2:4] == (4, 4) and (1, 1, 1, 1, "1") in got[3, 0][4] and (1, 3, 1, 1, "2") in got[3, 0][4]
    # a line of the ruled page: its columns are the page's
    assert got[1, 1] == ("page-columns", 0.2, 1, 2, [(0, 0, 1, 1, "1"), (0, 1, 1, 1, "2")])
    assert set(got) == {(1, 0), (1, 1), (2, 0), (3, 0)}


def test_marginal_grid_as_fallback(spark):
    """One word makes no grid of words; the page's ruled cell stands in."""
    got = found(spark, [word(1, 10, 5, "x")], ruled(1, [0, 100], [0, 50]), [(1, 1, 0, 0.0, 0.0, 100.0, 50.0)])
    assert got[1, 0][0] in ("page-columns", "lines") and got[1, 0][4] == [(0, 0, 1, 1, "x")]
    from tablewright.operators.region_tables import FINDERS

    df = spark.createDataFrame
    out = region_tables(df([word(1, 10, 5, "x")], WORDS), df(ruled(1, [0, 100], [0, 50]), SEGMENTS), df([(1, 1, 0, 0.0, 0.0, 100.0, 50.0)], REGIONS), (FINDERS[0], FINDERS[3])).collect()
    assert [(r.source, r.score, r.text) for r in out] == [("geometry-fallback", 0.1, "x")]


def channels_by_hand(words, height):
    left, right = min(w["x0"] for w in words), max(w["x1"] for w in words)
    width = right - left
    used = [w for w in words if w["x1"] - w["x0"] < 0.45 * width]
    if len(used) < max(4, len(words) // 4):
        used = words
    bins = [0] * (int(width / 0.5) + 2)
    for w in used:
        for i in range(int((w["x0"] - left) / 0.5), min(len(bins) - 1, int((w["x1"] - left) / 0.5)) + 1):
            bins[i] += 1
    out, i = [], 0
    while i < len(bins):
        j = i
        while j < len(bins) and not bins[j]:
            j += 1
        if j > i and i > 0 and j < len(bins) and j - i >= max(int(max(height * 0.4, 2) / 0.5), 2):
            out.append(left + (i + j) / 2 * 0.5)
        i = max(j, i + 1)
    return out


def test_channels_are_empty_bins():
    rng = random.Random(4)
    for _ in range(200):
        words = [{"x0": x, "x1": x + rng.choice([3.0, 10.5, 60.25]), "text": "w"} for x in (rng.choice([0, 40, 80.3, 150]) + rng.random() * 12 for _ in range(rng.randint(2, 14)))]
        assert channels(words, 10.0) == pytest.approx(channels_by_hand(words, 10.0))


def test_numbers_add_boundaries():
    words = [{"x0": e - 50, "x1": e, "text": t} for e in (100.0, 152.0, 300.0) for t in ("1,200.50", "(3)", "$7")] + [{"x0": 0.0, "x1": 300.0, "text": "long"}] * 3
    assert channels(words, 10.0) == [126.0, 201.25, 226.0]  # a white channel, and midpoints of numbers' edges that are not near it


def test_selected_columns(spark):
    tables = [
        ("two", [(0.0, 50.0), (60.0, 100.0)], 0.0, 100.0, [55.0]), ("one", [(0.0, 50.0), (60.0, 100.0)], 0.0, 55.0, []), ("none", [(0.0, 50.0), (60.0, 100.0)], 200.0, 300.0, None),
        ("narrow", [(0.0, 50.0)], 0.0, 100.0, None), ("same", [(0.0, 50.0), (0.04, 50.0)], 0.0, 50.0, None), ("tolerance", [(0.0, 50.0), (60.0, 100.0)], 27.0, 28.0, []), ("half", [(0.0, 10.0), (60.0, 100.0)], 80.0, 200.0, []), ("empty", [], 0.0, 9.0, None),
    ]
    rows = spark.createDataFrame([t[:4] for t in tables], "name string, ranges array<struct<x0:double,x1:double>>, a0 double, a1 double")
    got = {r.name: r.b for r in rows.select("name", selected_columns(F.col("ranges"), F.col("a0"), F.col("a1")).alias("b")).collect()}
    assert got == {t[0]: t[4] for t in tables}


def test_region_takes_the_table_it_overlaps_most(spark):
    tables = spark.createDataFrame([(1, 1, t, 0.0, 100.0 * t, 100.0, 100.0 * t + 90, [(0.0, 40.0), (50.0, 100.0 + t)]) for t in (0, 1)], "doc long, page int, table int, x0 double, y0 double, x1 double, y1 double, ranges array<struct<x0:double,x1:double>>")
    regions = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 100.0, 190.0), (1, 1, 1, 0.0, 80.0, 100.0, 160.0), (1, 1, 2, 0.0, 89.0, 100.0, 101.0), (1, 2, 3, 0.0, 0.0, 9.0, 9.0)], REGIONS)
    assert {(r.region, r.table) for r in region_columns(tables, regions).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_one_shuffle(spark):
    df = lambda kind: spark.createDataFrame([], kind)
    plan = region_tables(df(WORDS), df(SEGMENTS), df(REGIONS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc") <= 2


def touching_by_hand(boxes, gap):
    """Any two that touch become their bounding box, one pair at a time, until none do."""
    todo = [(*b, 1) for b in boxes]
    while True:
        pair = next(((i, j) for i in range(len(todo)) for j in range(i) if all(todo[j][k] <= todo[i][k + 2] + gap and todo[j][k + 2] >= todo[i][k] - gap for k in (0, 1))), None)
        if pair is None:
            return sorted(todo)
        i, j = pair
        a, b = todo.pop(i), todo.pop(j)
        todo.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]))


def test_touching_boxes():
    rng = random.Random(6)
    for n in (0, 1, 2, 5, 20, 60):
        for scale in (0.02, 0.1, 0.4):
            for _ in range(15):
                boxes = [(x, y, x + rng.random() * scale, y + rng.random() * scale * rng.choice([0, 0.3, 1])) for x, y in ((rng.random(), rng.random()) for _ in range(n))]
                assert fixpoint(boxes, 0.01) == touching_by_hand(boxes, 0.01)
    began = time.time()
    grid = [(x * 10.0, y * 10.0, x * 10.0 + 5, y * 10.0 + 5) for x in range(150) for y in range(150)]
    assert len(fixpoint(grid, 0.1)) == len(grid) and time.time() - began < 5


def test_borders_and_aligned_words():
    rect = lambda x0, y0, x1, y1: SimpleNamespace(text=None, x0=float(x0), y0=float(y0), x1=float(x1), y1=float(y1))
    w = lambda t, x, y: SimpleNamespace(text=t, x0=float(x), y0=float(y), x1=float(x + 20), y1=float(y + 10))
    # two that touch within 15 points, one alone, two specks
    rects = [rect(0, 0, 100, 20), rect(110, 0, 200, 20), rect(400, 400, 500, 500), rect(300, 0, 302, 50), rect(300, 60, 400, 61)]
    assert bordered(rects) == [(0.0, 0.0, 200 / 612, 20 / 792)]
    words = [w("a", 0, 30), w("b", 60, 30), w("c", 3, 50), w("d", 60, 50), w("lone", 0, 300)]
    assert [b[1] for b in aligned_tables(words)] == [2]
    # the bordered table and the words below it are a point apart on the page's scale
    merged = page_tables(rects + [w("a", 0, 26), w("b", 60, 26), w("c", 3, 46), w("d", 60, 46)])
    assert [(i, round(x1 * 612), round(y1 * 792)) for i, _, _, x1, y1 in merged] == [(0, 200, 56)]


def test_row_boxes_are_those_of_the_islands(spark):
    rng = random.Random(11)
    words = [(d, 1, float(x), y, x + 20.0, y + rng.choice([4.0, 10.0, 10.0, 30.0]), "w") for d in range(8) for x, y in ((rng.randrange(300), rng.choice([0.0, 3.0, 5.5, 12.0, 30.0, 31.0]) + 60 * rng.randrange(3)) for _ in range(rng.randint(1, 25)))]
    df = spark.createDataFrame(words, WORDS)
    want = row_islands(df).groupBy("doc", "page", "row").agg(F.count("*").alias("n"), F.min("x0"), F.max("x1"), F.min("y0"))
    assert sorted(map(tuple, row_boxes(df).collect())) == sorted(map(tuple, want.collect()))


def test_pages_of_one_form_have_their_lines_worked_out_once(monkeypatch):
    from tablewright.operators import region_tables as rt

    worked_out = []
    groups = rt.cell_groups
    monkeypatch.setattr(rt, "cell_groups", lambda *a: worked_out.append(1) or groups(*a))
    one = tuple(sorted(s[2:] for s in ruled(1, [3, 103, 203], [7, 27, 47])))
    at = lambda x, y, t: {"x0": x, "y0": y, "x1": x + 20.0, "y1": y + 10.0, "text": t}
    for i in range(50):
        segments, bounds = rt._region_ruling(rt._page_ruling(one), (0.0, 0.0, 210.0, 50.0))
        words = [at(10.0, 10.0, f"a{i}"), at(110.0, 10.0, "b"), at(110.0, 30.0, "c")]
        want = "geometry", 6.0, (2, 2, [(0, 0, 1, 1, f"a{i}"), (0, 1, 1, 1, "b"), (1, 0, 1, 1, ""), (1, 1, 1, 1, "c")])
        assert rt.best_table(words, segments, bounds, rt.FINDERS) == want and bounds == [103.0]
    assert len(worked_out) == 1
    assert rt.best_table(words, list(segments), bounds, rt.FINDERS) == want  # plain segments do as well


def test_a_page_of_more_lines_than_are_remembered(spark):
    from tablewright.operators.region_tables import REMEMBERED

    xs, ys = [40 * i for i in range(8)], [20 * i for i in range(9)]
    lines = ruled(1, xs, ys) + ruled(2, xs, ys)
    assert len(lines) / 2 > REMEMBERED
    words = [word(d, x + 5, y + 5, f"{x}") for d in (1, 2) for x in xs[:-1] for y in ys[:-1]]
    got = found(spark, words, lines, [(d, 1, 0, -1.0, -1.0, 300.0, 200.0) for d in (1, 2)])
    assert got[1, 0] == got[2, 0] == ("geometry", 56 * 1.875, 8, 7, [(r, c, 1, 1, f"{xs[c]}") for r in range(8) for c in range(7)])


def test_values_of_columns():
    import pyarrow as pa

    from tablewright.operators.pages import values

    for kind, there in ((pa.int64(), [2**62 + 1, None, -3]), (pa.int32(), [1, 2, 3]), (pa.float64(), [0.5, None, 2.0]), (pa.float64(), [0.5, 1.0]), (pa.string(), ["ä", None, ""]), (pa.string(), []), (pa.bool_(), [True, None]), (pa.float64(), [None, None])):
        got = values(pa.array(there, kind))
        assert got == there and [type(x) for x in got] == [type(x) for x in there]
