import pytest
from pyspark.sql import functions as F

from tablewright.functions.amounts import is_numeric_token, normalise_amount, parse_number
from tablewright.functions.dates import extract_date, normalise_date, normalise_range
from tablewright.functions.similarity import account_similar, edit_limit, property_similar
from tablewright.functions.text import header_key, sanitise
from tablewright.operators.fields import clean_value
from tablewright.operators.scalars import date_normalise


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i long, v string").select("i", f(F.col("v")).alias("r")).orderBy("i")
    return [r.r for r in rows.collect()]


DATES = {
    "Nov 11, 2025 - Dec 10, 2025": "11/11/2025", "11/01/2025-11/30/2025": "11/01/2025", "11/01/2025 - 11/30/2025": "11/01/2025",
    "November 1, 2025 through November 30, 2025": "11/01/2025", "Statement Period: Nov 11, 2025 to Dec 10, 2025": "11/11/2025",
    "Dec 11 - Jan 13, 2025": "12/11/2025", "Nov 11,26": "11/11/2026", "nov 11,2026": "11/11/2026", "11 Nov 2026": "11/11/2026",
    "SEPT 5, 2025": "09/05/2025", "12/31/2025": "12/31/2025", "2025-11-30": "11/30/2025", "January 5th, 2025": "01/05/2025",
    "01 / 31 / 2026": "01/31/2026", "September 2025": "09/01/2025", "no date": "no date",
}


def test_normalise_date(spark):
    assert apply(spark, normalise_date, DATES) == list(DATES.values())
    ends = ["Dec 11, 2024 - Jan 13, 2025", "Dec 11 - Jan 13, 2025", "01/13/2025"]
    assert apply(spark, lambda c: normalise_date(c, take_end=True), ends) == ["01/13/2025"] * 3


def test_normalise_range_mends_once(spark):
    """Both ends of a range as normalise_date gives each, from a text mended once."""
    texts = [*DATES, "Jan 5, 2024 to Feb 7, 2024", "March 3 - April 4, 2025", "05/06/2024-07/08/2024", "May 2024", "no date", " to ", "Jan 5, 2024 to ", "", None]
    t = spark.createDataFrame([(x,) for x in texts], "raw string")
    out = t.select("raw", F.inline(F.array(normalise_range(F.col("raw")))))
    want = t.select("raw", normalise_date(F.col("raw")).alias("first"), normalise_date(F.col("raw"), take_end=True).alias("last"))
    assert [tuple(r) for r in out.collect()] == [tuple(r) for r in want.collect()]
    mends = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Ist")
    assert mends(date_normalise(spark, "/root/testdata/sf0.001")) == 1 < mends(want)


def test_extract_date(spark):
    assert apply(spark, lambda c: extract_date(c, take_end=True), ["Dec 11 2024 - Jan 13 2025"]) == ["01/13/2025"]
    assert apply(spark, extract_date, ["October 5, 2025", "20250131", "Foo: 15-Jan-2022", ""]) == ["NONE", "01/31/2025", "01/15/2022", "NONE"]


#: Text, start and end as the server's extraction reads them.
EXTRACTED = [
    ("Jan 9. 2025", "01/09/2025", "01/09/2025"), ("2025 Jan 9", "01/09/2025", "01/09/2025"), ("01 31 2026", "01/31/2026", "01/31/2026"), ("31 01 2026", "01/31/2026", "01/31/2026"), ("Jan 9 ,2025", "01/09/2025", "01/09/2025"),
    ("the 5th day of March, 2024", "03/05/2024", "03/05/2024"), ("15-Oct-2025", "NONE", "NONE"), ("Bill Date: 3/4/25 12:30 PM", "03/04/2025", "03/04/2025"), ("Feb 30, 2025", "NONE", "NONE"), ("2025/13/01", "NONE", "NONE"),
    ("Dec 11 2024 to Jan 13 2025", "12/11/2024", "01/13/2025"), ("Dec 1 - Jan 3, 2025", "12/01/2025", "01/03/2025"), ("11/01/2025-11/30/2025", "11/01/2025", "11/30/2025"), ("1/O5/2025", "01/05/2025", "01/05/2025"), ("l2/31/2025", "12/31/2025", "12/31/2025"),
    ("Ol/02/2025", "01/02/2025", "01/02/2025"), (" to Jan 13 2025", "01/13/2025", "01/13/2025"), ("due date 12.31.69", "12/31/2069", "12/31/2069"), ("12.31.70", "12/31/1970", "12/31/1970"), ("Jan", "NONE", "NONE"), ("01312025", "01/31/2025", "01/31/2025"), ("from Dec 11 - Jan 13, 2025 to Feb 3 2026", "01/11/2013", "02/03/2026"), (None, "NONE", "NONE"),
]


def test_extract_shapes(spark):
    texts = [t for t, _, _ in EXTRACTED]
    got = list(zip(texts, apply(spark, extract_date, texts), apply(spark, lambda c: extract_date(c, take_end=True), texts), strict=True))
    assert got == EXTRACTED


def test_ranges_by_separator_order(spark):
    s = "Dec 11 - Jan 13, 2025 to Feb 3 2026"
    assert apply(spark, normalise_date, [s, "a – b", " - Jan 3 2025", "Jan 9. 2025"]) == ["01/13/2025", "a", "01/03/2025", "Jan 9. 2025"]
    assert apply(spark, lambda c: normalise_date(c, take_end=True), [s, "Jan 3 2025 - ", "Jan 3 - "]) == ["02/03/2026", "2025", "Jan 3 -"]  # an empty end borrows the year; without one it is no range


def test_amounts(spark):
    assert apply(spark, normalise_amount, ["$1,234.56", "34503450", "1212", "(123.45)", "abc", None]) == ["1234.56", "3450.00", "12.00", "123.45", "abc", None]
    assert apply(spark, lambda c: normalise_amount(c, strict=True), ["1212"]) == ["1212.00"]
    assert apply(spark, parse_number, ["12abc", "$1,200", "(1500", "abc", ".5"]) == [12.0, 1200.0, None, None, 0.5]
    assert apply(spark, is_numeric_token, ["$1,200.50", "(12%)", "a1", "--"]) == [True, True, False, False]


def test_text(spark):
    assert apply(spark, sanitise, ["[sig|req|signer1] Rent", "Doc ID: 7af 3450 3450", "HelloHello", "a\u0000b 0101010101", ""]) == ["Rent", "3450", "Hello", "ab", None]
    fractions = ["0.01000100", "$0.01000100 0101010101", "12.00000000", "see order 10000101", "no.01010101"]
    assert apply(spark, lambda c: sanitise(c, keep_fractions=True), fractions) == ["0.01000100", "$0.01000100", "12.00000000", "see order", "no."]
    assert apply(spark, sanitise, fractions) == ["0.", "$0.", "12.", "see order", "no."]
    assert apply(spark, lambda c: clean_value(F.lit("cap_rate"), c), ["0.01000100", "0.0150015"]) == ["0.01000100", "0.0150015"]
    assert apply(spark, header_key, ["Account No.", "Service End-Date"]) == ["accountno", "serviceenddate"]


@pytest.mark.parametrize(("n", "limit"), [(6, 1), (12, 2), (13, 1), (14, 2), (20, 3)])
def test_edit_limit(spark, n, limit):
    assert spark.range(1).select(edit_limit(F.lit(n))).first()[0] == limit


def test_similar(spark):
    rows = spark.createDataFrame([("XXXX1234", "00981234", "Oak Park Apartments", "Oak Park LLC"), ("12", "98", "Elm", "Birchwood Manor")], "a string, b string, c string, d string")
    got = rows.select(account_similar(F.col("a"), F.col("b")), property_similar(F.col("c"), F.col("d"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]
