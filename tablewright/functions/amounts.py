"""Amounts, percents, years and typed cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def parse_number(c: Column) -> Column:
    """The number a text starts with, once $, commas and white space are out; null if it starts with none."""
    return F.regexp_extract(F.regexp_replace(c, r"[$,\s]", ""), r"^[+-]?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def normalise_amount(c: Column, strict: bool = False) -> Column:
    """Amount with two decimals. Keeps digits, points, commas, dollars and minus; a text of even length whose halves are
    equal is taken for one printed twice, unless strict; parentheses lose their sign; what isn't a number stays raw."""

    def read(kept: Column) -> Column:
        half = (F.char_length(kept) / 2).cast("int")
        twice = (F.char_length(kept) > 0) & (F.char_length(kept) % 2 == 0) & (F.substr(kept, F.lit(1), half) == F.substr(kept, half + 1))
        once = kept if strict else F.when(twice, F.substr(kept, F.lit(1), half)).otherwise(kept)
        return F.regexp_extract(F.regexp_replace(once, r"[$,]", ""), r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("decimal(20,2)").cast("string")

    return F.coalesce(let(F.regexp_replace(F.trim(c), r"[^0-9.,$-]", ""), read), c)


def is_numeric_token(c: Column) -> Column:
    """Has a digit, and nothing but digits once , . - ( ) $ % are out."""
    return F.regexp_replace(c, r"[,.\-()$%]", "").rlike(r"^\d+$")


def normalise_percent(c: Column) -> Column:
    """Fractions between 0 and 1 become percents."""
    n = F.regexp_replace(c, r"[%\s]", "").try_cast("double")
    return F.when(n.isNull(), c).when((n > 0) & (n < 1), (n * 100).cast("string")).otherwise(n.cast("string"))


def normalise_year(c: Column) -> Column:
    """The first four digits in a row that start with 19 or 20; else the text."""
    y = F.regexp_extract(c, r"(?:19|20)\d{2}", 0)
    return F.when(y == "", c).otherwise(y)
