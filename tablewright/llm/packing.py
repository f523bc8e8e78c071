"""Best-fit packing of tokenised documents, improved by swap-based local search."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

MAX_TOKENS = 2048
VOCABULARY = "byte_bpe_50k"
#: Pieces packed together; more give hardly fewer sequences, fewer leave a part-filled sequence more often.
GROUP = 20_000
#: Words whose ids a worker remembers, about 20 MB each for words with and without a space; the first met, as common words come early.
CACHE = 100_000


class _Odd(Exception):
    """White space that can't be cut at."""


class _Words(dict):
    """Word to its ids as bytes; encodes what it hasn't seen."""

    def __init__(self, encoding, before: str):
        self.encoding, self.before = encoding, before

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():  # one pretoken
            ids = self.encoding._core_bpe.encode_single_piece((self.before + word).encode())
        elif not word:
            ids = self.encoding.encode_ordinary(self.before)
        elif len(word.split()) != 1 or word[0].isspace() or word[-1].isspace():
            raise _Odd
        else:
            ids = self.encoding.encode_ordinary(self.before + word)
        found = array("I", ids).tobytes()
        if len(self) < CACHE:
            self[word] = found
        return found


class ByteTokenizer:
    """Ids of a byte-level BPE vocabulary, as little-endian unsigned 32-bit bytes: the ids that its .json gives in
    the tokenizers library with add_special_tokens=False.

    The .tiktoken file of the same vocabulary is several times as fast, more so word by word with a memory: no pretoken
    crosses a single space or newline. Texts with other white space are encoded whole. The one special
    token, where a text spells it, is an id of its own between two texts.
    """

    SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

    def __init__(self, json_path: str):
        import public_tokenizers
        import tiktoken

        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spaced, self.first = _Words(self.encoding, " "), _Words(self.encoding, "")
        self.newline = array("I", self.encoding.encode_ordinary("\n")).tobytes()

    def encode(self, text: str) -> bytes:
        if self.SPECIAL in text:
            return array("I", [self.SPECIAL_ID]).tobytes().join(self.encode(x) if x else b"" for x in text.split(self.SPECIAL))
        if not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] in (" ", "\n")):
            try:
                parts: list[bytes] = []
                for i, line in enumerate(text.split("\n")):
                    if i:
                        parts.append(self.newline)
                    words = line.split(" ")
                    if words[0]:
                        parts.append(self.first[words[0]])
                    parts.extend(map(self.spaced.__getitem__, words[1:]))
                return b"".join(parts)
            except _Odd:
                pass
        return array("I", self.encoding.encode_ordinary(text)).tobytes()


_TOKENIZERS: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str | None) -> ByteTokenizer:
    """One for each worker; the default path is looked up where the worker runs."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(f"{VOCABULARY}.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ByteTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Rows (_id, piece, start, length, ids_crc32, and ids unless with_ids is off) of every whole text, null being empty.
    A document is its ids and end_id; only documents over max_tokens are cut, into full pieces but for the first."""
    end = array("I", [end_id]).tobytes()
    kind = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(tokenizer)
        for b in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, text in enumerate(b.column(1)):
                buf = tok.encode(text.as_py() or "") + end
                n = len(buf) // 4
                at = (n - 1) % max_tokens + 1  # the end of the first piece
                start, piece = 0, 0
                while start < n:
                    ids = buf[4 * start : 4 * at]
                    rows.append(i)
                    for c, v in zip(cols, (piece, start, at - start, zlib.crc32(ids), ids if with_ids else None), strict=True):
                        c.append(v)
                    start, at, piece = at, at + max_tokens, piece + 1
            out = [b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:4])]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(cols[4], pa.binary())] if with_ids else []), ["_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(cut, f"_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: for each k, items over capacity - k stay alone beside those over half, and what is
    at least k fills the rest."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1)
    items, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = ceil(total[-1] / capacity)
    for k in range(1, capacity // 2 + 1):
        alone = items[-1] - items[capacity - k]
        half_n, half_sum = items[capacity - k] - items[capacity // 2], total[capacity - k] - total[capacity // 2]
        small = total[capacity // 2] - total[k - 1]
        best = max(best, alone + half_n + max(0, ceil((small - (half_n * capacity - half_sum)) / capacity)))
    return int(best)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: items (indices), the largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-sizes, kind="stable"):
        n = int(sizes[i])
        rooms = open_rooms >> n
        if rooms:
            room = n + (rooms & -rooms).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(int(i))
        else:
            b, room = len(bins), capacity
            bins.append([int(i)])
        if room - n:
            by_room.setdefault(room - n, []).append(b)
            open_rooms |= 1 << (room - n)
    return bins


class _Offers:
    """What each bin could give for one larger item: its items, and its pairs of items, one of each sum. A bin that
    changes is listed anew and its old entries are blanked, until half of the list is blank."""

    def __init__(self, sizes: np.ndarray, members: list[set[int]]):
        self.sizes, self.members, self.where = sizes, members, [(0, 0)] * len(members)
        self._rebuild()

    def _of(self, b: int) -> dict[int, tuple[int, int]]:
        many: dict[int, list[int]] = {}
        for i in self.members[b]:
            many.setdefault(int(self.sizes[i]), []).append(i)
        out = {n: (items[0], -1) for n, items in many.items()}
        of = sorted(many)
        for k, n in enumerate(of):
            for m in of[: k + 1]:
                if n != m or len(many[n]) > 1:
                    out.setdefault(n + m, (many[n][0], many[m][-1]))
        return out

    def _rebuild(self) -> None:
        self.sums, self.bins, self.items, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros((1024, 2), np.int64), 0  # grown by doubling
        self.blank = 0
        for b in range(len(self.members)):
            self._add(b)

    def _add(self, b: int) -> None:
        offers = self._of(b)
        lo, hi = self.used, self.used + len(offers)
        if hi > len(self.sums):
            more = max(len(self.sums), len(offers))
            self.sums, self.bins, self.items = (np.concatenate([x, np.zeros((more, *x.shape[1:]), np.int64)]) for x in (self.sums, self.bins, self.items))
        if offers:
            self.sums[lo:hi], self.bins[lo:hi], self.items[lo:hi] = list(offers), b, list(offers.values())
        self.where[b], self.used = (lo, hi), hi

    def renew(self, b: int) -> None:
        lo, hi = self.where[b]
        self.sums[lo:hi] = 1 << 40  # larger than any item
        self.blank += hi - lo
        self._add(b)
        if 2 * self.blank > self.used:
            self._rebuild()


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empties bins by moves and exchanges that increase the sum of squared fills.

    Every bin with room is a source, the emptiest first. An item of the source is moved to the fullest bin with
    room for it; else exchanged for one smaller item of another bin, or for two that are smaller together, whichever
    adds most to the sum of squares; so the source shrinks and the others fill up. Sources are gone through again until
    none gains. Every step increases a bounded integer, so the search ends; it also ends when the number of bins meets the lower bound.
    """
    least = lower_bound(sizes, capacity)
    if len(bins) <= least:
        return [sorted(b) for b in bins]
    place = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        place[items] = b
    fill = np.bincount(place, sizes, len(bins)).astype(np.int64)
    live = int((fill > 0).sum())
    members = [set(x) for x in bins]
    offers = _Offers(sizes, members)

    def shift(item: int, to: int) -> None:
        source = place[item]
        members[source].discard(item)
        members[to].add(item)
        fill[source] -= sizes[item]
        fill[to] += sizes[item]
        place[item] = to

    def improve(a: int) -> bool:
        room = capacity - fill
        room[a] = -1
        room[fill == 0] = -1
        at = np.flatnonzero(room[offers.bins[: offers.used]] > 0)
        sums, where = offers.sums[at], offers.bins[at]
        roomy, lead = room[where], fill[where] - fill[a]
        for n, x in sorted({int(sizes[i]): i for i in members[a]}.items(), reverse=True):
            fits = np.flatnonzero(room >= n)
            fits = fits[fill[fits] + n > fill[a]]
            if len(fits):
                to = int(fits[np.argmin(room[fits])])
                shift(x, to)
            else:
                d = n - sums  # what the other bin gains
                ok = np.flatnonzero((d > 0) & (d <= roomy))
                gain = d[ok] * (lead[ok] + d[ok])
                if not len(ok) or gain.max() <= 0:
                    continue
                best = at[ok[np.argmax(gain)]]
                to = int(offers.bins[best])
                for y in offers.items[best].tolist():
                    if y >= 0:
                        shift(y, a)
                shift(x, to)
            offers.renew(a)
            offers.renew(to)
            return True
        return False

    stepped = True
    while stepped and live > least:
        stepped = False
        for a in np.argsort(fill, kind="stable"):
            if not 0 < fill[a] < capacity:
                continue
            while fill[a] and improve(a):
                stepped = True
            live -= not fill[a]
            if live <= least:
                break
    return [sorted(m) for m in members if m]


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to rows (_row, _id, piece, length, ids_crc32, ...); _row tells the rows apart and must be the same at every
    read, as in a written table. Full pieces are sequences of their own; the others are dealt by hash into groups of about `group`
    pieces, each packed in one task of bounded size."""
    small = pieces.filter(F.col("length") < max_tokens)
    groups = max(1, ceil(small.count() / group))
    keyed = small.withColumn("_group", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", "_row"), F.lit(groups)))

    def solve(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "piece", "_row"], ignore_index=True)
        sizes = rows["length"].to_numpy(np.int64)
        at, where = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for b, items in enumerate(local_search(sizes, best_fit(sizes, max_tokens), max_tokens)):
            where[items] = (int(key[0]) << 32) + b
            at[items] = np.cumsum(sizes[items]) - sizes[items]
        return pd.DataFrame({"_row": rows["_row"], "sequence_id": where, "offset": at})

    placed = keyed.groupBy("_group").applyInPandas(solve, "_row long, sequence_id long, offset long")
    small = keyed.drop("_group").join(placed, "_row").drop("_row")
    full = pieces.filter(F.col("length") >= max_tokens).withColumns({"sequence_id": -1 - F.col("_row"), "offset": F.lit(0).cast("long")}).drop("_row")
    return small.unionByName(full)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, tokenizer: str | None = None, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """One row per piece: the id, piece, start, length, ids_crc32, sequence_id, offset, and ids (unsigned 32-bit
    little-endian bytes) unless with_ids is off.

    Null and empty texts are one piece with the end id only; repeated rows are packed each; tokenizer is the path of the
    vocabulary's .json, by default the installed one. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.write(token_pieces(docs, id_col, text_col, max_tokens, tokenizer, with_ids=with_ids).withColumn("_row", F.monotonically_increasing_id()))
    return pack(pieces, max_tokens, group).withColumnRenamed("_id", id_col)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)
