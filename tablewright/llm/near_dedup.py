"""MinHash near-dedup: bottom-k sketches, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, or_empty, slot_filter, slot_of, slot_test, table
from .components import components

SHINGLE = 5
THRESHOLD = Fraction(4, 5)
#: Values that a sketch retains.
SKETCH = 48
#: Retained values that two linked sketches share at least: each of the 48 least values of the union is shared with
#: probability 0.8 or more, so fewer than 23 are in at most 4 of 10**7 pairs of just 0.8, and hardly ever above that.
SHARED = 23
#: Retained values in a row that make the key of an inverted list, where the sets are large enough. In the order of the hashes, the 48
#: least values of the union hold no 3 shared ones in a row in 1 of 10**7 pairs of just 0.8.
RUN = 3
#: Members of a group whose full sets meet in one task.
BLOCK = 512
#: Shingles of those sets, on average; 24 bytes each.
BLOCK_SHINGLES = 2_000_000
#: Slots of the filters, at most 4 MB broadcast.
FILTER = 1 << 24
#: Words whose hashes a task remembers, about 30 MB.
WORDS = 200_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, seen: dict[bytes, int] | None = None) -> np.ndarray:
    """The document's set, as sorted 63-bit hashes: its distinct shingles of `size` words (A-Z lower-cased, cut at ASCII white
    space); with fewer words, the whole sequence; without words, empty. seen remembers hashes of words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.int64)
    seen = {} if seen is None else seen
    ids = list(map(seen.get, words))
    if None in ids:
        if len(seen) >= WORDS:
            seen.clear()
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = seen[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(ids, np.uint64)
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * _MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64), pa.int64()))


def sketches(rows: DataFrame, size: int, keep: int | None) -> DataFrame:
    """rows (_id, _text) to (_id, n, a, b, hashes): the set's size, two hashes that name the set, and its `keep` least values
    (None: all)."""
    kind = rows.schema["_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                sets = [shingle_set(t.as_py(), size, seen) for t in part.column(1)]
                names = [_mix(s.astype(np.uint64) + _MIX[0]) for s in sets]
                a = np.array([x.sum(dtype=np.uint64) if len(x) else 0 for x in names], np.uint64).astype(np.int64)
                x = np.array([np.bitwise_xor.reduce(_mix(x + _MIX[1])) if len(x) else 0 for x in names], np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a), pa.array(x), _lists([s[:keep] for s in sets])], ["_id", "n", "a", "b", "hashes"])

    return rows.mapInArrow(read, f"_id {kind}, n long, a long, b long, hashes array<long>")


def runs_needed(threshold: Fraction, keep: int, longest: int) -> dict[int, list[int]]:
    """Run length to the sizes of sets, up to keep, that need keys of that many retained values.

    Two linked sets whose union has u values differ in at most (1 - threshold) * u of them. In the order of the hashes, those cut the
    shared ones into stretches, the longest of which has at least the length returned here; where the union is retained
    whole, nothing is left to chance. A set of size n meets unions of n to n / threshold.
    """
    out: dict[int, list[int]] = {}
    for n in range(1, keep + 1):
        for u in range(n, floor(n / threshold) + 1):
            differ = floor((1 - threshold) * u)
            run = min(longest, ceil(Fraction(u - differ, differ + 1)))
            if differ and n not in out.setdefault(run, []):
                out[run].append(n)
    return out


def _key_of(run: int):
    return lambda i: F.xxhash64(F.lit(run), *[F.get("hashes", i + k) for k in range(run)])


class Judge:
    """Decides links: the union sketch's estimate filters, the exact Jaccard of the full sets (sorted hashes) verifies."""

    def __init__(self, threshold: Fraction, keep: int, shared: int):
        self.num, self.den, self.keep, self.shared = threshold.numerator, threshold.denominator, keep, shared

    def linked(self, x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        """Which of the other sets are linked to x."""
        n = np.fromiter(map(len, others), np.int64, len(others))
        out = np.zeros(len(others), bool)
        most = np.maximum(n, len(x))
        at = np.flatnonzero(self.den * np.minimum(n, len(x)) >= self.num * most)
        if len(at):
            likely = self._estimate(x[: self.keep], [others[i][: self.keep] for i in at], len(x) + n[at], most[at])
            at = at[likely]
        if len(at):
            inner = self._shared(x, [others[i] for i in at])[0]
            out[at] = self.den * inner >= self.num * (len(x) + n[at] - inner)
        return out

    @staticmethod
    def _shared(x: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each other set the number of values shared with x; for each of all their values its place in x, whether it is there,
        and the sets' first places among all values. No set is empty."""
        flat = np.concatenate(others)
        first = np.concatenate([[0], np.cumsum([len(o) for o in others[:-1]])]).astype(np.int64)
        place = np.searchsorted(x, flat)
        there = x[np.minimum(place, len(x) - 1)] == flat
        return np.add.reduceat(there.astype(np.int64), first), place, there, first

    def _estimate(self, x: np.ndarray, others: list[np.ndarray], both: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Where the union is retained whole, its sketch decides; else at least `shared` of its `keep` least values must be in
        both. A shared value's place in the union is its places in the two sketches less the shared ones before it."""
        inner, place, there, first = self._shared(x, others)
        size = np.fromiter(map(len, others), np.int64, len(others))
        own = np.arange(len(place)) - np.repeat(first, size)
        run = np.cumsum(there) - there
        before = run - np.repeat(run[first], size)
        least = np.add.reduceat((there & (place + own - before < self.keep)).astype(np.int64), first)
        return np.where(most <= self.keep, self.den * inner >= self.num * (both - inner), least >= self.shared)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of a partition that is sorted by the keys, group by group."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        of = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        at = 0
        for i, key in enumerate(of):
            if key != last:
                if i > at:
                    held.append(b.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, at, last = [], i, key
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _edges(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], kind) for c in (0, 1)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: Fraction = THRESHOLD, keep: int = SKETCH, shared: int = SHARED, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: the id, n_shingles, component_id, kept.

    Documents whose shingle sets have a Jaccard similarity of at least threshold are linked; component_id is the least id
    reachable, and the document with that id is kept. Texts without a word (or null) have an empty set and are linked with
    nothing. Rows that share an id are one node; rows without an id are linked to nobody but equal sets, and kept if
    they have none with an id. An empty table gives no rows; other columns of docs are not read.

    1. Each set is reduced to its `keep` least hashes (bottom-k), and equal sets to one representative, the least id.
    2. Inverted lists hold the representatives by runs of `run` retained values that are neighbours in the order of the hashes
       (shorter runs for the smallest sets, see runs_needed). Linked sets share such a run.
    3. The overlaps: a list's leader is the member whose lists are longest in all, the one nearest to the middle of its near copies,
       so that one leads most lists of a group. A leader's group is all members of the lists it leads; two documents that
       share a list share a group. A group of at most `block` members is compared in one task, but for pairs that are
       connected by then. In a larger one each member is compared with the leader, in a stream that any number of tasks share.
    4. In larger groups, members in another component than their leader are compared with the whole group, those in the leader's
       component not with each other. Blocks of members, dealt by hash and bounded in number and size, meet pairwise in a
       task, which goes on from the known components and gives the links that join two. So a large group costs its size, plus its
       size times the number of members that the leader doesn't link, over the block size, in rows shuffled; no pair becomes a
       row unless it is linked.
    Every pair's union sketch filters first, the exact Jaccard of the full sets decides. Full sets are made where they meet, of the texts
    of documents in some list of two or more, which move in their place as they are half as large. A slot filter of bounded size picks
    those in the scan; once it is full it lets others through, to be dropped by the join.
    """
    scratch = Scratch(docs.sparkSession, "near")
    judge = Judge(threshold, keep, shared)
    rows = docs.select(F.col(id_col).alias("_id"), or_empty(F.col(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    sk = scratch.write(sketches(rows, shingle, keep))
    classes = scratch.write(sk.filter("n > 0").groupBy("n", "a", "b").agg(F.min("_id").alias("rep")))

    # sets of fewer than threshold / (1 - threshold) can only be linked with equal ones; the filter clears most sets of being copies
    smallest = ceil(threshold / (1 - threshold))
    name = slot_of(F.col("n"), F.col("a"), F.col("b"), slots=FILTER)
    copied = scratch.write(slot_filter(sk.filter(F.col("n") >= smallest).groupBy("n", "a", "b").agg(F.count("*").alias("m")).filter("m > 1").select(name.alias("slot")).distinct()))
    marked = slot_test(sk.filter((F.col("n") >= smallest) & F.col("_id").isNotNull()).withColumn("_slot", name), "_slot", copied, "_in")
    copies = marked.filter("_in").join(classes.select(F.col("rep").alias("_id"), "n", "a", "b"), ["_id", "n", "a", "b"], "left_semi").dropDuplicates(["_id", "n", "a", "b"])
    reps = marked.filter("not _in").select("_id", "n", "hashes").unionAll(copies.select("_id", "n", "hashes"))
    keys = []
    for r, sizes in sorted(runs_needed(threshold, keep, run).items()):
        least, most = min(sizes), keep if r < run else 1 << 62
        at = F.sequence(F.lit(0), F.greatest(F.size("hashes") - r, F.lit(0)))
        made = F.transform(at, _key_of(r))
        wanted = F.col("n").between(least, max(sizes) if r < run else most) & (F.size("hashes") >= r)
        keys.append(F.when(wanted, made).otherwise(F.array().cast("array<bigint>")))
    entries = reps.select("_id", "n", F.explode(F.concat(*keys)).alias("value"))
    long = entries.groupBy("value").agg(F.count("*").alias("m")).filter("m > 1")
    lists = scratch.write(entries.join(long, "value").select("value", "m", "_id", "n"))
    scratch.release()

    weight = lists.groupBy("_id").agg(F.sum("m").alias("w"))
    leader = lists.join(weight, "_id").groupBy("value").agg(F.max(F.struct("w", F.xxhash64("_id").alias("h"), "_id")).alias("x")).select("value", F.col("x._id").alias("l"))
    groups = scratch.write(lists.join(leader, "value").select("l", "_id", "n").distinct())

    picked = scratch.write(slot_filter(groups.select(slot_of(F.col("_id"), slots=FILTER).alias("slot")).distinct()))
    texts = lambda words: slot_test(rows.withColumn("_slot", slot_of(F.col("_id"), slots=FILTER)), "_slot", words, "_in").filter("_in").select("_id", "_text")

    def within_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (l, part, whole, follows, _id, n, _text), sorted: the leader comes first. Whole groups are gathered; else the members stream
        past the leader's sets."""
        key, held, own, seen = None, [], [], {}

        def settle() -> list[tuple]:
            found, label = [], np.arange(len(held))
            for x in range(len(held)):
                other = x + 1 + np.flatnonzero(label[x + 1 :] != label[x])
                if len(other):
                    for y in other[judge.linked(held[x][1], [held[k][1] for k in other])]:
                        if label[y] != label[x]:
                            found.append((held[x][0], held[y][0]))
                            label[label == label[y]] = label[x]
            held.clear()
            return found

        for b in batches:
            found = []
            ids, text, n, whole, follows = b.column("_id"), b.column("_text"), *(b.column(c).to_pylist() for c in ("n", "whole", "follows"))
            for i, k in enumerate(zip(b.column("l").to_pylist(), b.column("part").to_pylist(), strict=True)):
                if k != key:
                    found += settle()
                    key, own = k, []
                x = shingle_set(text[i].as_py(), shingle, seen)
                if len(x) != n[i]:  # another text of the same id
                    continue
                if whole[i]:
                    held.append((ids[i].as_py(), x))
                elif not follows[i]:
                    own.append(x)
                elif judge.linked(x, own).any():
                    found.append((ids[i].as_py(), k[0]))
            yield _edges(found, ids.type)
        if held:
            yield _edges(settle(), ids.type)

    parts = groups.groupBy("l").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"), (F.sum("n") <= BLOCK_SHINGLES).alias("few")).select("l", "parts", ((F.col("parts") == 1) & F.col("few")).alias("whole"))
    part = F.when(F.col("_id") == F.col("l"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")))
    dealt = scratch.write(groups.join(parts, "l").select("l", "_id", "n", "whole", (F.col("_id") != F.col("l")).alias("follows"), F.explode(part).alias("part")))
    # groups and blocks grow with the table, so they aren't broadcast even where they would fit
    streams = dealt.hint("merge").join(texts(picked), "_id").repartition("l", "part").sortWithinPartitions("l", "part", "follows").select("l", "part", "whole", "follows", "_id", "n", "_text")
    edges = scratch.write(streams.mapInArrow(within_groups, f"a {kind}, b {kind}"))
    scratch.release()
    comps = scratch.write(components(edges, scratch))

    of = lambda key, name: comps.select(F.col("node").alias(key), F.col("component").alias(name))
    large = dealt.filter("not whole and (follows or part = 0)").select("l", "_id", "n")
    known = large.join(of("_id", "c"), "_id", "left").join(of("l", "cl"), "l", "left")
    known = scratch.write(known.select("l", "_id", "n", F.coalesce("c", "_id").alias("c"), (~F.coalesce("c", "_id").eqNullSafe(F.coalesce("cl", "l"))).alias("apart")))
    room = lambda cond: F.greatest(F.ceil(F.count_if(cond) / block), F.ceil(F.sum(F.when(cond, F.col("n"))) / BLOCK_SHINGLES)).cast("int")
    mixed = known.groupBy("l").agg(room(F.col("apart")).alias("out"), room(~F.col("apart")).alias("rest")).filter("out > 0")
    # blocks 0 .. out - 1 hold those apart, the next ones the others
    at = F.when(F.col("apart"), F.pmod(F.xxhash64("_id"), F.col("out"))).otherwise(F.col("out") + F.pmod(F.xxhash64("_id"), F.col("rest"))).cast("int")
    last = F.when(F.col("apart"), F.col("out") + F.col("rest") - 1).otherwise(F.col("out") - 1)
    meets = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least(at, k).alias("i"), F.greatest(at, k).alias("j")))
    blocks = known.join(mixed, "l").select("l", "_id", "n", "c", "apart", at.alias("at"), F.explode(meets).alias("x")).select("l", "_id", "n", "c", "apart", "at", "x.i", "x.j")

    def within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (l, i, j, at, _id, n, c, apart, _text), sorted: blocks i and j meet; links that join components come out."""
        seen: dict[bytes, int] = {}
        for g in _groups(batches, ["l", "i", "j"]):
            ids, comp, at, apart = g["_id"].to_pylist(), g["c"].to_pylist(), g["at"].to_numpy(), g["apart"].to_numpy(zero_copy_only=False)
            names = {c: k for k, c in enumerate(dict.fromkeys(comp))}
            label = np.array([names[c] for c in comp])
            hashes = [shingle_set(t.as_py(), shingle, seen) for t in g["_text"]]
            own = np.fromiter(map(len, hashes), np.int64) == g["n"].to_numpy()  # else another text of the same id
            i, j = g["i"][0].as_py(), g["j"][0].as_py()
            found = []
            for x in np.flatnonzero(own & apart & (at == i)):
                other = np.flatnonzero(own & (at == j) & (label != label[x]) & ((np.arange(len(at)) > x) | (i != j)))
                if not len(other):
                    continue
                for y in other[judge.linked(hashes[x], [hashes[k] for k in other])]:
                    if label[y] != label[x]:
                        found.append((ids[x], ids[y]))
                        label[label == label[y]] = label[x]
            yield _edges(found, g["_id"].type)

    far = scratch.write(slot_filter(known.select(slot_of(F.col("_id"), slots=FILTER).alias("slot")).distinct()))
    meeting = blocks.hint("merge").join(texts(far), "_id").repartition("l", "i", "j").sortWithinPartitions("l", "i", "j").select("l", "i", "j", "at", "_id", "n", "c", "apart", "_text")
    more = scratch.write(meeting.mapInArrow(within_blocks, f"a {kind}, b {kind}"))
    comps = scratch.write(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), scratch))

    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("_component"))
    named = scratch.write(named)
    by_id = F.coalesce("_component", "_id")
    out = sk.select("_id", "n", "a", "b").join(named, ["n", "a", "b"], "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), by_id.alias("component_id"), F.col("_id").eqNullSafe(by_id).alias("kept"))
    scratch.drop(classes, copied, lists, groups, dealt, known, picked, far, edges, more)
    return out


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
