"""Keys on pages by plain loops, and values placed beside them."""

import random

from pyspark.sql import functions as F

from tablewright.operators.anchors import Keys, anchor, anchor_values, page_hits, plain

WORDS = "doc long, page int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double"
PAIRS = "pair long, doc long, page int, kx double, ky double, kw double, kh double, vx double, vy double, vw double, vh double"


def test_keys_by_find():
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice("ab ") for _ in range(60))
        keys = ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 4))) for _ in range(6)] + ["", "a", "a"]
        want = []
        for i, k in enumerate(keys):
            at = text.find(k) if k else -1
            while at >= 0:
                want.append((i, at, at + len(k)))
                at = text.find(k, at + len(k))
        assert sorted(Keys(keys).hits(text)) == sorted(want)
    assert list(Keys([""]).hits("x")) == []


def test_boxes_span_words():
    words = [{"text": t, "x0": x, "y0": y, "x1": x + 10.0 * len(t or ""), "y1": y + 8.0} for t, x, y in (("Acct:", 0.0, 0.0), ("Balánce", 60.0, 1.0), ("—", 130.0, 0.0), (None, 0.0, 0.0), ("due", 0.0, 20.0), ("BALANCE", 40.0, 20.0))]
    got = page_hits(words, Keys(["balance due", "lance", "acct balance", "zz"]))
    # a hit on two lines spans both; part of a word takes its share of the letters; a colon takes width but no letter
    assert sorted(got) == [(0, 0, 0.0, 1.0, 130.0, 28.0), (1, 0, 80.0, 1.0, 130.0, 9.0), (1, 1, 60.0, 20.0, 110.0, 28.0), (2, 0, 0.0, 0.0, 130.0, 9.0)]
    assert plain("  Ça—va, ½ ﬁne!") == "ca va 1 2 fine"


def test_anchor(spark):
    rows = [("75 Debit(s) This Period In All", "Debit(s) This Period In"), ("1,5 2. 3 4 5", "1,5 2. 3 4"), ("Total", "Total"), ("", "")]
    got = spark.createDataFrame(rows, "t string, want string").select(anchor(F.col("t")).alias("a"), "want").collect()
    assert all(r.a == r.want for r in got)


def words_of(doc, page, *lines):
    return [(doc, page, i, k, t, 10.0 * x, 20.0 * i, 10.0 * x + 6 * len(t), 20.0 * i + 10) for i, line in enumerate(lines) for k, (x, t) in enumerate(line)]


def test_values_beside_keys(spark):
    words = spark.createDataFrame(
        [
            *words_of(1, 1, [(0, "12"), (2, "Total"), (6, "due"), (20, "9.00")], [(0, "Total"), (4, "due")]),
            *words_of(1, 2, [(0, "x")], [(3, "TOTAL"), (7, "due:")], [(1, "Total"), (5, "due")]),  # two hits, the first counts; a table makes it the second
            *words_of(1, 3, [(0, "nothing")]),
            *words_of(1, 4, *[[(0, "x")]] * 30, [(2, "total"), (6, "due")]),  # far below: counts for want of a nearer one
            *words_of(2, 1, [(30, "Total"), (34, "due")]), *words_of(2, 2, [(59, "Total"), (60, "due")]),
        ], WORDS)
    pages = spark.createDataFrame([(d, p, 612.0, 792.0) for d, n in ((1, 4), (2, 2)) for p in range(1, n + 1)], "doc long, page int, width double, height double")
    pairs = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 90.0, 12.0, 200.0, 0.0, 30.0, 12.0), (1, 1, 1, 400.0, 300.0, 50.0, 20.0, 5.0, 5.0, 9.0, 9.0)], PAIRS)
    tables = spark.createDataFrame([(1, 2, 0.0, 38.0, 100.0, 60.0)], "doc long, page int, t_x0 double, t_y0 double, t_x1 double, t_y1 double")

    def found(**more):
        return {(r.pair, r.doc, r.page): (r.x, r.y, round(r.width, 3), r.how) for r in anchor_values(words, pairs, pages, **more).collect()}

    # the key's hit on its own page is at 20, 0: the value is 180 to its right
    own = {(0, 1, 2): (210.0, 20.0, 30.0, "match"), (0, 1, 3): (200.0, 0.0, 30.0, "source"), (0, 1, 4): (200.0, 600.0, 30.0, "match")}
    assert found() == own
    assert found(tables=tables) == own | {(0, 1, 2): (190.0, 40.0, 30.0, "match")}
    only = found(tables=tables, table_only=True)
    assert only[0, 1, 2] == (190.0, 40.0, 30.0, "match") and only[0, 1, 4][3] == only[0, 1, 3][3] == "source"
    # another document by this one's template: its first page too, and the unreadable key's value on the page of the same number
    to = spark.createDataFrame([(1, 2)], "source long, doc long")
    assert found(targets=to) == {(0, 2, 1): (480.0, 0.0, 30.0, "match"), (1, 2, 1): (5.0, 5.0, 9.0, "absolute")}
