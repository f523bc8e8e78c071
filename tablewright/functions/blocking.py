"""Keys under which texts must meet to be similar: each rule of functions.similarity holds only between texts that share one.

A text has keys that it is found by and keys that it looks for; of two similar texts, one looks for a key that the other is found by.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations
from math import floor

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import STOP_WORDS

#: Longest part of a text that it looks for among the parts of others; what is longer looks for its beginning.
PART = 16
_WORD = re.compile(r"[^a-z0-9_\s]", re.A)

Keys = tuple[set[str], set[str]]


def plain(text: str) -> str:
    """As functions.text.normalise_text."""
    return " ".join(_WORD.sub(" ", text.lower()).split())


def parts(text: str, least: int) -> Keys:
    """Keys of texts one of which contains the other, of least characters or more: all parts against whole texts."""
    if len(text) < least:
        return set(), set()
    found = {"c" + text[i : i + n] for n in range(least, min(PART, len(text)) + 1) for i in range(len(text) - n + 1)}
    return found, {"c" + text[:PART]}


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """(start, size) of edits + 1 parts of nearly equal size. Within so many edits one of them is left as it is."""
    n, longer = divmod(length, edits + 1)
    sizes = [n + (i >= edits + 1 - longer) for i in range(edits + 1)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def edits(text: str, limit: Callable[[int], int]) -> Keys:
    """Keys of texts within limit(length of the shorter) edits: the shorter is found by its segments, the longer looks for them where edits can have moved
    them. Texts too short to be cut meet all that are as short."""
    length, n = len(text), limit(len(text))
    found = {f"s{length}.{i}.{text[a : a + size]}" for i, (a, size) in enumerate(segments(length, n))} if length > n else {"short"}
    wanted, most_ever = set(), max(map(limit, range(length + 1)))
    for other in range(length, max(length - most_ever, 0) - 1, -1):
        most, ahead = limit(other), length - other
        if ahead > most:
            continue
        if other <= most:
            wanted.add("short")
            continue
        for i, (a, size) in enumerate(segments(other, most)):
            for shift in range(max(-i, ahead - (most - i)), min(i, ahead + most - i) + 1):
                if 0 <= a + shift <= length - size:
                    wanted.add(f"s{other}.{i}.{text[a + shift : a + shift + size]}")
    return found, wanted


def words(tokens: list[str], few: int = 2) -> Keys:
    """Keys of token sets that share two tokens, or one where one of them has `few` at most."""
    of = sorted(set(tokens))
    two = {f"w{a} {b}" for a, b in combinations(of, 2)}
    one = {f"o{t}" for t in of}
    return two | (one if len(of) <= few else set()), two | one


def _tokens(text: str) -> list[str]:
    return [w for w in text.split() if len(w) >= 2]


def property_keys(value: str) -> Keys:
    p = plain(value)
    return _all(words([t for t in _tokens(p) if t not in STOP_WORDS]), parts(p, 2), edits(p, lambda n: max(3, floor(n * 0.3))))


def address_keys(value: str) -> Keys:
    p = plain(value)
    tokens = _tokens(p)
    kept = [t for t in tokens if t not in STOP_WORDS]
    both = {f"n{n} {w}" for n in tokens if n.isdigit() for w in kept}
    return _all(words(kept), (both, both), parts(p, 4), edits(p, lambda n: max(4, floor(n * 0.25))))


def account_keys(value: str) -> Keys:
    d = re.sub(r"[^0-9]", "", value)
    last4, last3 = ({"4" + d[-4:]} if len(d) >= 4 else set()), ({"3" + d[-3:]} if len(d) >= 3 else set())
    return _all((last4, last4), (last3 if len(d) <= 6 else set(), last3), parts(d, 1))


def edit_limit(length: int) -> int:
    """As functions.similarity.edit_limit."""
    return 1 if length <= 6 else 2 if length <= 12 else min(3, floor(length * 0.15))


def spelling_keys(value: str) -> Keys:
    """Either text's limit may hold, and lengths of limits don't follow the lengths, so the largest nearby is taken."""
    return edits(re.sub(r"\s+", " ", value.lower(), flags=re.A).strip(" "), lambda n: max(edit_limit(k) for k in range(n, n + 4)))


def _all(*keys: Keys) -> Keys:
    return set().union(*(k[0] for k in keys)), set().union(*(k[1] for k in keys))


def keyed(values: DataFrame, rule: str, rules: dict[str, Callable[[str], Keys]]) -> DataFrame:
    """values (id, value, and a column naming the rule) to (id, key, looks): its keys, and whether it looks for them or is found by them."""
    kind = values.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows, keys, looks = [], [], []
                for i, (v, r) in enumerate(zip(part.column("value").to_pylist(), part.column(rule).to_pylist(), strict=True)):
                    for look, ks in enumerate(rules[r](v)):
                        rows += [i] * len(ks)
                        keys += ks
                        looks += [bool(look)] * len(ks)
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.string()), pa.array(looks, pa.bool_())], ["id", "key", "looks"])

    return values.select("id", "value", rule).mapInArrow(read, f"id {kind}, key string, looks boolean")
