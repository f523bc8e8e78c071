"""Operators that SQL can't express, and functions without a query of their own, against plain loops on small inputs."""

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from tablewright.functions.amounts import normalise_percent, normalise_year
from tablewright.functions.similarity import account_similar, address_similar, close_spelling, edit_limit, property_similar
from tablewright.functions.text import search_key
from tablewright.operators.extraction import first_match
from tablewright.operators.fields import clean_value
from tablewright.operators.geometry import right_edges, words_in_rect
from tablewright.operators.linkage import MERGE_FIELDS, RULES, distinct_values, merge_groups, pairs, star_groups, starred
from tablewright.operators.matching import find_text
from tablewright.operators.page_folds import aligned_tables, expand_spans, lines_of
from tablewright.operators.page_sources import cell_text, choose_words
from tablewright.sources import xlsx
from tablewright.sources.layout import words


def star_by_hand(values, similar):
    """Greedy: values in order; each untaken one takes the later untaken ones that are similar to it."""
    taken, out = set(), []
    for i, seed in enumerate(values):
        if seed not in taken:
            members = [v for v in values[i + 1 :] if v not in taken and similar(seed, v)]
            if members:
                taken |= {seed, *members}
                out += [(seed, v) for v in [seed, *members]]
    return out


def decide(spark, values, predicate):
    """The Column predicate over all ordered pairs, as a set."""
    rows = spark.createDataFrame([(a, b) for a in values for b in values], "a string, b string")
    return {(r.a, r.b) for r in rows.filter(predicate(F.col("a"), F.col("b"))).collect()}


def some_values(n, seed):
    rng = random.Random(seed)
    base = ["North Power", "NorthPower Co", "City Water Works", "Agave Village", "Agave Villge", "Stonegate", "12 Elm Street", "12 Elm St Unit 4", "XXXX1234", "00981234", "5551234"]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice("abe 1")
        out.append("".join(w).strip())
    return list(dict.fromkeys(x for x in out if x))


def test_star_and_spelling_groups(spark):
    values = some_values(40, 1)
    rows = spark.createDataFrame([("f", v, i) for i, v in enumerate(values)], "field string, name string, at int")
    for rule, predicate in (("property", property_similar), ("spelling", close_spelling)):
        similar = decide(spark, values, predicate)
        found = distinct_values(rows, ["field"], "name", "at")
        got = star_groups(pairs(found, ["field"], rule), ["field"]).collect()
        assert sorted((r.seed, r.value) for r in got) == sorted(star_by_hand(values, lambda a, b: (a, b) in similar))


def test_similar_values_share_a_key(spark):
    """Every pair that a rule calls similar meets, of random texts of all lengths, short and empty ones too."""
    rng = random.Random(8)
    values = list(dict.fromkeys(["", "!", "a", "ab", "12", "x 12", *some_values(60, 5), *("".join(rng.choice("ab 1") for _ in range(rng.randint(1, 22))).strip() for _ in range(60))]))
    values = [v for v in values if v.strip()]
    rows = spark.createDataFrame([("f", v, i) for i, v in enumerate(values)], "field string, name string, at int")
    found = distinct_values(rows, ["field"], "name", "at")
    for rule, predicate in {"property": property_similar, "account": account_similar, "address": address_similar, "spelling": close_spelling}.items():
        assert rule in RULES
        at = {v: i for i, v in enumerate(values)}
        want = sorted((a, b) for a, b in decide(spark, values, predicate) if at[a] < at[b])
        for few in (0, 10**6):
            assert sorted((r.a, r.b) for r in pairs(found, ["field"], rule, few).collect()) == want, (rule, few)


def test_no_product_of_a_group(spark):
    rows = distinct_values(spark.createDataFrame([("f", "v", 1)], "field string, name string, at int"), ["field"], "name", "at")
    plan = pairs(rows, ["field"], "property", 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and any("key" in line for line in plan.splitlines() if "Join Inner" in line)


def test_long_chains_of_stars(spark):
    """Each value is similar to the next: every second one is a seed, as many rounds as it takes."""
    n = 12
    found = spark.createDataFrame([("f", f"v{i:02}", f"v{i + 1:02}", i, i + 1) for i in range(n)], "field string, a string, b string, sa int, sb int")
    got = {(r.seed, r.value) for r in star_groups(found, ["field"]).collect()}
    assert got == {(f"v{i:02}", f"v{k:02}") for i in range(0, n, 2) for k in (i, i + 1)}


def test_merge_groups(spark):
    """Auto groups, others, manual groups, single values, by each field's own rule; the two accounts of the vectors are alike."""
    by_field = {"provider_name": some_values(12, 2), "property_name": ["Zephyr Heights", "Stonegate Commons"], "account_number": ["XXXX1234", "00981234", "777000"], "address": ["12 Elm Street"], "amount": ["1", "2"]}
    rows = spark.createDataFrame([("o", f, f" {v} ", i) for f, vs in by_field.items() for i, v in enumerate(vs)], "office string, field string, value string, seq int")
    want = []
    rules = {"provider_name": property_similar, "property_name": property_similar, "account_number": account_similar, "address": address_similar}
    for f, name in MERGE_FIELDS.items():
        similar = decide(spark, by_field[f], rules[f])
        auto = star_by_hand(by_field[f], lambda a, b, s=similar: (a, b) in s)
        rest = [v for v in by_field[f] if v not in {x for _, x in auto}]
        want += [(f, name, s, v) for s, v in auto]
        if len(rest) >= 2:
            want += [(f, name + (" (other)" if auto else " (manual)"), None, v) for v in rest]
    got = [(r.field, r.label, r.seed, r.value) for r in merge_groups(rows, ["office"]).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ("account_number", "Account Number", "XXXX1234", "00981234") in got and any(x[1] == "Property Name (manual)" for x in got)


def test_folds_and_rounds_agree(spark):
    """A group in one row and a group by pairs and rounds have the same stars and counts, by every rule; a group without a key has values, but nothing is similar in it."""
    groups = {"f": some_values(26, 3), "g": some_values(9, 4), "one": ["alone"], None: ["North Power", "North Power 1"]}
    rows = spark.createDataFrame([(k, v, i) for k, vs in groups.items() for i, v in enumerate(vs)], "field string, name string, at int")
    found = distinct_values(rows, ["field"], "name", "at")
    for rule, predicate in {"property": property_similar, "account": account_similar, "address": address_similar, "spelling": close_spelling}.items():
        want = []
        for k, vs in groups.items():
            similar = decide(spark, vs, predicate) if k else set()
            of = {v: seed for seed, v in star_by_hand(vs, lambda a, b, s=similar: (a, b) in s)}
            want += [(k, v, of.get(v), len(of), len(vs) - len(of)) for v in vs]
        for few in (12, 10**6):
            got = [(r.field, r.value, r.seed, r.starred, r.alone) for r in starred(found, ["field"], rule, few).collect()]
            assert sorted(got, key=str) == sorted(want, key=str), (rule, few)


def test_small_groups_are_not_joined(spark):
    """What a reader may merge in small groups takes no join of their values, pairs or stars (F19)."""
    rows = spark.createDataFrame([(o, "provider_name", v, i) for o in "pq" for i, v in enumerate(some_values(12, 2))], "office string, field string, value string, seq int")
    assert "Join" not in merge_groups(rows, ["office"])._jdf.queryExecution().optimizedPlan().toString()


def test_find_text(spark):
    texts = [(1, "Total  due:\n total Due and TOTALDUE, total due"), (2, None), (3, "aaaa"), (4, "Straße total\tdue")]
    got = find_text(spark.createDataFrame(texts, "doc long, text string"), ["total due", "aa"]).collect()
    want = set()
    for i, t in texts:
        for q in ("total due", "aa"):
            pattern = r"\s+".join(map(re.escape, q.split()))
            want |= {(i, q, k) for k, _ in enumerate(re.finditer(pattern, t or "", re.I))}
    assert {(r[0], r.query, r.hit) for r in got} == want
    by = dict(texts)
    assert all(" ".join(by[r[0]][r.start : r.end].lower().split()) == r.query for r in got)


def _words(spark, rows):
    return spark.createDataFrame([(1, 1, *r) for r in rows], "doc long, page int, text string, x0 double, y0 double, x1 double, y1 double")


def test_right_edges(spark):
    """Two columns of right-aligned numbers and no boundary known: one is added midway, one near a known boundary isn't."""
    rows = [(f"{10 ** (k % 4)}", e - 6.0 * (k % 4 + 1), 12.0 * k, e, 12.0 * k + 10) for k in range(6) for e in (150.0, 250.0, 350.0)]
    w = _words(spark, rows)
    have = spark.createDataFrame([(1, 1, 203.0)], "doc long, page int, boundary double")
    got = right_edges(w, have).collect()
    flat = sorted(x for r in got for x in (r.asDict().get("boundaries") or [r.asDict().get("boundary")]))
    assert flat == [203.0, 300.0]


def test_aligned_tables_and_lines():
    from types import SimpleNamespace as W

    word = lambda t, x, y: W(text=t, x0=float(x), y0=float(y), x1=float(x + 30), y1=float(y + 10))
    page = [word("a", 10, y) for y in (100, 112, 124)] + [word("b", 200, y) for y in (100, 112, 124)] + [word("alone", 10, 300)] + [word("c", 10, 500), word("d", 90, 500), word("e", 400, 512), word("f", 480, 512)]
    assert aligned_tables(page) == [(0, 3, 10.0, 100.0, 230.0, 134.0)]
    many = [word("x", 10 * k, 100 + k * 0.01) for k in range(200)]
    assert [len(line[-1].split()) for line in lines_of(many)] == [200]


def test_spans_and_cells(spark):
    cells = spark.createDataFrame([(1, 1, 0, 0, 2, 2, "big"), (1, 1, 0, 2, 1, 1, "x")], "doc long, page int, row int, col int, rowspan int, colspan int, text string")
    assert {(r.row, r.col): r.text for r in expand_spans(cells).collect()} == {(0, 0): "big", (0, 1): "", (1, 0): "", (1, 1): "", (0, 2): "x"}
    w = _words(spark, [("b", 50.0, 101.0, 60.0, 111.0), ("a", 10.0, 100.0, 20.0, 110.0), ("c", 5.0, 107.0, 9.0, 117.0), (" ", 0.0, 0.0, 1.0, 9.0)])
    assert cell_text(w, ["doc", "page"]).first()["text"] == "a b\nc"
    assert words_in_rect(_words(spark, [("12", 0.0, 0.0, 12.0, 10.0), ("34", 13.0, 0.0, 25.0, 10.0), ("x", 40.0, 0.0, 46.0, 10.0)]), spark.sql("SELECT 0 AS region, 1 AS page, 0D AS a0, 0D AS b0, 99D AS a1, 20D AS b1")).first()["text"] == "1234 x"


def test_choose_words(spark):
    native = _words(spark, [("n", 0.0, 0.0, 1.0, 1.0)]).unionAll(_words(spark, [("many", 0.0, float(k), 1.0, 1.0) for k in range(150)]).withColumn("page", F.lit(2))).unionAll(_words(spark, [("kept", 0.0, 0.0, 1.0, 1.0)]).withColumn("page", F.lit(3)))
    read = _words(spark, [("o", 0.0, 0.0, 1.0, 1.0)]).unionAll(_words(spark, [("o", 0.0, 0.0, 1.0, 1.0)]).withColumn("page", F.lit(2)))
    pages = spark.createDataFrame([(1, 1, True), (1, 2, True), (1, 3, True)], "doc long, page int, is_ocr boolean")
    assert {(r.page, r.source, r.text) for r in choose_words(native, read, pages).collect()} == {(1, "ocr", "o"), (2, "native", "many"), (3, "native", "kept")}


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    lit = F.lit
    assert [one(normalise_percent(lit(x))) for x in ("12%", "0.5", "x")] == ["12.0", "50.0", "x"]
    assert [one(normalise_year(lit(x))) for x in ("FY 2024/25", "none")] == ["2024", "none"]
    assert one(search_key(lit("  Ｃafé,  Ⅷ! "))) == "cafe, viii"
    value, confidence = first_match(lit("Acct: 55 Total: 9"), [r"Nope: (\d+)", r"Total: (\d+)", r"Acct: (\d+)"])
    assert (one(value), one(confidence)) == ("9", "high")
    late = first_match(lit("Acct: 55"), ["a(b)", "c(d)", r"Acct: (\d+)"])
    assert (one(late[0]), one(late[1])) == ("55", "medium")
    assert one(xlsx.as_tsv(F.array(lit("a\tb"), lit(None).cast("string"), lit("c\nd")))) == "a b\t\tc d"
    assert one(xlsx.as_html(F.array(lit("a<b"), lit("c&d")))) == "<tr><td>a&lt;b</td><td>c&amp;d</td></tr>"
    heads = [(["Name", "1"], 2), (["1,234", "-5.0"], 2), (["Name"], 1), (["12 34"], 2), ([" ", "7"], 3)]
    assert [one(xlsx.looks_like_header(F.array(*map(lit, cells)), lit(n))) for cells, n in heads] == [True, False, False, True, False]
    assert [one(edit_limit(lit(n))) for n in (6, 12, 13, 14, 20)] == [1, 2, 1, 2, 3]
    assert one(clean_value(lit("billing_date"), lit("Dec 11 2024 - Jan 13 2025"))) == "01/13/2025" and one(clean_value(lit("cap_rate"), lit("0.05"))) == "0.05"


def test_layout_of_long_lines(spark):
    """Offsets go on over the strides, also past blanks."""
    rng = random.Random(4)
    texts = [(i, "\n".join(" ".join(rng.choice(["", "a", "bb", "ccc", "é"]) for _ in range(rng.choice([0, 1, 31, 32, 33, 64, 200]))) for _ in range(60))) for i in range(5)]
    got = {(r.doc, r.line, r.word_no): (r.text, r.x0, r.x1, r.page, r.y0) for r in words(spark.createDataFrame(texts, "id long, text string"), "id").collect()}
    want = {}
    for i, t in texts:
        for row, line in enumerate(t.split("\n")):
            at = 0
            for k, w in enumerate(line.split(" ")):
                if w:
                    want[i, row, k] = (w, at * 6.0, (at + len(w)) * 6.0, row // 50 + 1, row % 50 * 12.0)
                at += len(w) + 1
    assert got == want
    first = words(spark.createDataFrame(texts, "id long, text string"), "id", last_page=1)
    assert first.count() == sum(k[1] < 50 for k in want)
    by_page = defaultdict(int)
    for k in want:
        by_page[k[1] // 50 + 1] += 1
    assert by_page[1] == first.count()


def test_label_values(spark):
    from tablewright.operators.label_search import label_values
    from tablewright.sources.layout import words

    rest = "\n\n\n\n\nother words that make this page one of more than ten"
    pages = [(1, "Due date : 03/04/2024" + rest), (2, "Due date       here" + rest), (3, "My due date\n   soon and later" + rest), (4, "due\ndate\n --" + rest), (5, "Due date: x"), (6, "Date due y | z" + rest), (7, "" + rest)]
    found = label_values(words(spark.createDataFrame(pages, "id long, t string"), "id", "t"), [("when", "Due Date"), ("when", "due"), ("never", "no such label"), ("empty", "")])
    rows = {(r.doc, r.field): r.value for r in found.collect()}
    # 2: one word beside the label, however far; 4: a separator below the first label, the word below the second; 5: too few words; 6: the second label of the field
    assert rows == {(1, "when"): "03/04/2024", (2, "when"): "here", (3, "when"): "soon", (4, "when"): "date", (6, "when"): "y"}
    assert label_values(words(spark.createDataFrame([], "id long, t string"), "id", "t"), [("a", "b")]).count() == 0
