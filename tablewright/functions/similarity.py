"""Similarity of names, accounts and addresses, as Column predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normalise_text, plain_tokens, significant


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared(a, b) / F.size(F.array_union(a, b)))


def edit_limit(length: Column) -> Column:
    """Edits that texts of a length may differ by: 1 up to 6, 2 up to 12, then 15%, at most 3. Not monotone: 13 gives 1."""
    return F.when(length <= 6, 1).when(length <= 12, 2).otherwise(F.least(F.lit(3), F.floor(length * 0.15).cast("int")))


def _shorter(a: Column, b: Column) -> Column:
    return F.least(F.char_length(a), F.char_length(b))


def forms(c: Column, rule: Column | None = None) -> Column:
    """What the predicates below compare, so that it is made once per value and not once per pair. Where the name of a rule is given, what others compare is null."""
    by = lambda made, *rules: made if rule is None else F.when(rule.isin(*rules), made)
    numbers = lambda words: F.filter(words, lambda w: w.rlike(r"^\d+$"))
    rest = [by(F.regexp_replace(c, "[^0-9]", ""), "account").alias("digits"), by(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), "spelling").alias("spelt")]
    worded = lambda plain, words: F.struct(c.alias("raw"), plain.alias("plain"), significant(words).alias("kept"), by(numbers(words), "address").alias("numbers"), *rest)
    return let(by(normalise_text(c), "property", "address"), lambda plain: let(plain_tokens(plain), lambda words: worded(plain, words)))


def property_alike(a: Column, b: Column) -> Column:
    """Of two forms."""
    na, nb, sa, sb = a["plain"], b["plain"], a["kept"], b["kept"]
    both = (F.size(sa) > 0) & (F.size(sb) > 0)
    n = shared(sa, sb)
    close = F.levenshtein(na, nb) <= F.greatest(F.lit(3), F.floor(_shorter(na, nb) * 0.3))
    alike = F.contains(na, nb) | F.contains(nb, na) | (both & ((jaccard(sa, sb) >= 0.5) | (n >= 2) | ((n >= 1) & (F.least(F.size(sa), F.size(sb)) <= 2)))) | close
    return (a["raw"] != "") & (b["raw"] != "") & ((na == nb) | ((_shorter(na, nb) >= 2) & alike))


def account_alike(a: Column, b: Column) -> Column:
    da, db = a["digits"], b["digits"]
    short = _shorter(da, db)
    last = lambda k: F.right(da, F.lit(k)) == F.right(db, F.lit(k))
    return (short > 0) & (((short >= 4) & last(4)) | ((short >= 3) & (short <= 6) & last(3)) | F.contains(da, db) | F.contains(db, da))


def address_alike(a: Column, b: Column) -> Column:
    na, nb, sa, sb = a["plain"], b["plain"], a["kept"], b["kept"]
    both = (F.size(sa) > 0) & (F.size(sb) > 0)
    words = both & ((jaccard(sa, sb) >= 0.4) | ((shared(a["numbers"], b["numbers"]) >= 1) & (shared(sa, sb) >= 1)))
    close = F.levenshtein(na, nb) <= F.greatest(F.lit(4), F.floor(_shorter(na, nb) * 0.25))
    return (a["raw"] != "") & (b["raw"] != "") & ((na == nb) | ((_shorter(na, nb) >= 4) & (F.contains(na, nb) | F.contains(nb, na) | words | close)))


def spelling_alike(a: Column, b: Column) -> Column:
    """Within the edits that the first text's length allows, lengths compared first."""
    limit = edit_limit(F.char_length(a["spelt"]))
    return (F.abs(F.char_length(a["spelt"]) - F.char_length(b["spelt"])) <= limit + 1) & (F.levenshtein(a["spelt"], b["spelt"]) <= limit)


def property_similar(a: Column, b: Column) -> Column:
    return property_alike(forms(a), forms(b))


def account_similar(a: Column, b: Column) -> Column:
    return account_alike(forms(a), forms(b))


def address_similar(a: Column, b: Column) -> Column:
    return address_alike(forms(a), forms(b))


def close_spelling(a: Column, b: Column) -> Column:
    return spelling_alike(forms(a), forms(b))
