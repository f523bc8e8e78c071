"""Text cleaning, tokens and names."""

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say little about a property or an address.
STOP_WORDS = (
    "the", "a", "an", "and", "of", "at", "in", "on", "llc", "inc", "corp", "co",
    "ltd", "lp", "llp", "apartments", "apt", "apts", "st", "street", "rd", "road",
    "ave", "avenue", "blvd", "boulevard", "dr", "drive", "ln", "lane", "pl", "place",
    "ct", "court", "unit", "suite", "ste", "fl", "floor",
)


# Fixed patterns: signature tags, document ids, other bracketed tags, characters of no use.
NOISE = (
    r"(?i)\[(?:text|sig|date|initial|checkbox|radio|attachment|note)[^\]]*\]",
    r"(?i)\bDoc(?:ument)?\s*ID\s*:\s*\S+",
    r"(?i)\[[a-z]+\|[^\]]{0,120}\]",
    r"[^\p{L}\p{N}\p{P}\p{Z}\p{Sc}\p{Sm}]",
)
#: Hidden binary numbers, and those of them that are not the fraction of a decimal number.
HIDDEN = r"\b[01]{8,}\b"
HIDDEN_WHOLE = rf"(?<!\d\.){HIDDEN}"


def let(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c) with c evaluated once, however often it is used: expressions nested by plain repetition grow exponentially."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def halve_double(c: Column) -> Column:
    """A text printed twice, with or without a space between, once."""
    n = F.char_length(c)
    half = (n / 2).cast("int")
    left = F.substr(c, F.lit(1), half)
    return (
        F.when(n < 2, c)
        .when((n % 2 == 1) & (F.substr(c, half + 1, F.lit(1)) == " ") & (left == F.substr(c, half + 2)), left)
        .when((n % 2 == 0) & (left == F.substr(c, half + 1)), left)
        .otherwise(c)
    )


def sanitise(c: Column, keep_fractions: bool = False) -> Column:
    """Without signature tags, document ids, characters that aren't letters, numbers, punctuation, separators, currency or
    mathematical signs, and hidden binary numbers (with keep_fractions, not those that are a decimal number's digits after the point); white
    space is one space; doubled texts once; null if nothing is left."""
    s = c
    for pattern in (*NOISE, HIDDEN_WHOLE if keep_fractions else HIDDEN):
        s = F.regexp_replace(s, pattern, "")
    return let(F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " ")), lambda x: F.when(x != "", halve_double(x)))


def normalise_text(c: Column) -> Column:
    """Lower case, ASCII word characters and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9_\s]", " "), r"\s+", " "))


def tokens(c: Column, least: int = 2) -> Column:
    return plain_tokens(normalise_text(c), least)


def plain_tokens(plain: Column, least: int = 2) -> Column:
    """Of a text that normalise_text has been over."""
    return F.filter(F.split(plain, " "), lambda w: F.char_length(w) >= least)


def significant(words: Column) -> Column:
    """Of tokens."""
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))


def significant_tokens(c: Column) -> Column:
    return significant(tokens(c))


def header_key(c: Column) -> Column:
    """A header's letters and digits, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


_EDGE = ".,:;!?()[]{}\"'"


#: Texts that a worker holds as Python's own at a time, of a batch.
SLICE = 256


def _batchwise(one: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Column function of texts, a batch at a time; what is ASCII alone is the same in every normal form, so Python sees it once per distinct text."""

    def column(c: Column) -> Column:
        def part(texts: pa.Array) -> pa.Array:
            known = texts.dictionary_encode()
            return pa.array([one(x) for x in known.dictionary.to_pylist()], pa.string()).take(known.indices)

        def run(texts: pa.Array) -> pa.Array:
            return pa.concat_arrays([part(texts.slice(at, SLICE)) for at in range(0, max(len(texts), 1), SLICE)])

        return F.arrow_udf(run, "string")(c)

    return column


def _basic(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


def _search(text: str) -> str:
    if not text.isascii():
        text = "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))
    return " ".join(text.lower().split()).strip(_EDGE)


def normalise_basic(c: Column) -> Column:
    """Compatibility-composed (NFKC), single spaces, none at the ends. Spark has no composition of its own."""
    return _batchwise(_basic)(c)


def search_key(c: Column) -> Column:
    """Compatibility-decomposed (NFKD), without marks, lower case, single spaces, edge punctuation off."""
    return _batchwise(_search)(c)
