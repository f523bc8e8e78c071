"""Ranked lexical search: inverted lists per document shard, pivots by maximum impacts, one heap per item and task."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

TOP = 50
#: A shard ends with the document that fills one of these: documents, and entries of its lists (8 bytes each).
SHARD_DOCS, SHARD_ENTRIES = 4096, 1 << 18
#: Terms of the items, and items, that one block reads against all documents; what is broadcast is bounded by them, about 20 MB.
BLOCK_TERMS, BLOCK_ITEMS = 200_000, 10_000

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 0x80 else 32 for c in range(256))
_NO_ID = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other than ASCII, in UTF-8, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_TERM).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms): an item's distinct terms. Rows that share an id are one item."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(set(terms(t.as_py()))) for t in b.column(1)], pa.list_(pa.binary()))], ["item", "terms"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(read, "item long, terms array<binary>").groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def build_shards(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """docs to shards, a row each: `docs` documents with a term and `tokens` terms in them; ids and sizes of those that hold terms of the
    vocabulary; and for each such term (its place in the vocabulary, ascending) a list of documents (places in ids, ascending) and counts.
    Repeated rows are documents of their own."""
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        ids, sizes, of, term, tf = [], [], [], [], []
        n = tokens = 0

        def shard() -> pa.RecordBatch:
            t, at, k = np.array(term, np.int32), np.array(of, np.int32), np.array(tf, np.int32)
            order = np.argsort(t, kind="stable")
            name, count = np.unique(t, return_counts=True)
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays(
                [one(n, pa.int64()), one(tokens, pa.int64()), one(ids, pa.list_(pa.int64())), one(sizes, pa.list_(pa.int64())), one(name, pa.list_(pa.int32())), one(count, pa.list_(pa.int32())), one(at[order].tobytes(), pa.binary()), one(k[order].tobytes(), pa.binary())],
                ["docs", "tokens", "ids", "sizes", "terms", "counts", "lists", "tfs"],
            )

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = terms(text.as_py())
                if not found:
                    continue
                n, tokens = n + 1, tokens + len(found)
                held = Counter(map(get, found))
                held.pop(None, None)
                if held:
                    of += [len(ids)] * len(held)
                    ids.append(_NO_ID if i is None else i)
                    sizes.append(len(found))
                    term += held.keys()
                    tf += held.values()
                if len(ids) >= SHARD_DOCS or len(term) >= SHARD_ENTRIES:
                    yield shard()
                    ids, sizes, of, term, tf, n, tokens = [], [], [], [], [], 0, 0
        if n:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(build, "docs long, tokens long, ids array<long>, sizes array<long>, terms array<int>, counts array<int>, lists binary, tfs binary")


class Shard:
    """Inverted lists of some documents, with each posting's impact and each list's maximum."""

    def __init__(self, row: dict, all_docs: int, all_tokens: int, n_terms: int):
        self.ids = np.array(row["ids"], np.int64)
        size = np.array(row["sizes"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))])
        self.docs = np.frombuffer(row["lists"], np.int32)
        tf = np.frombuffer(row["tfs"], np.int32).astype(np.int64)
        m = 50 + 50 * size * all_docs // all_tokens
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.docs])
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(tf) else np.empty(0, np.int64)
        self.place = np.full(n_terms, -1)
        self.place[np.array(row["terms"], np.int64)] = np.arange(len(row["terms"]))


class TopK:
    """The best documents of an item so far: greatest scores, ties to smaller ids. `least` is what a further one must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = self.ids = np.empty(0, np.int64)

    def push(self, scores: np.ndarray, ids: np.ndarray) -> None:
        self.scores, self.ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((self.ids, -self.scores))[: self.k]
        self.scores, self.ids = self.scores[best], self.ids[best]
        if len(best) == self.k:
            self.least = int(self.scores[-1])

    def search(self, shard: Shard, wanted: np.ndarray, weight: np.ndarray) -> None:
        """WAND over the shard's lists of the wanted terms.

        With lists in order of their maximum impacts, those before the pivot list can't reach the threshold together, so a document
        that is in none from there on is never looked at. Of the others a document is a pivot if the maxima of the
        lists that may hold it reach the threshold. Only pivots are scored; the lists before the pivot list are entered by binary search, the
        largest maximum first, for those that can still reach it.
        """
        at = shard.place[wanted]
        w, at = weight[at >= 0], at[at >= 0]
        most = w * shard.most[at]
        order = np.argsort(most, kind="stable")
        w, at, most = w[order], at[order], most[order]
        reach = np.cumsum(most)
        pivot = int(np.searchsorted(reach, self.least))
        if pivot == len(at):
            return
        first, n = shard.first[at], shard.first[at + 1] - shard.first[at]
        spans = [slice(a, a + k) for a, k in zip(first[pivot:], n[pivot:], strict=True)]
        docs = np.concatenate([shard.docs[s] for s in spans])
        below = reach[pivot - 1] if pivot else 0
        bound = np.bincount(docs, np.repeat(most[pivot:], n[pivot:]), len(shard.ids)) + below
        ready = np.zeros(len(shard.ids), bool)
        ready[docs] = True
        pivots = np.flatnonzero(ready & (bound >= self.least))
        if not len(pivots):
            return
        impact = np.concatenate([shard.impact[s] for s in spans]) * np.repeat(w[pivot:], n[pivot:])
        score = np.bincount(docs, impact, len(shard.ids))[pivots].astype(np.int64)
        for k in range(pivot - 1, -1, -1):
            can = score + reach[k] >= self.least
            pivots, score = pivots[can], score[can]
            if not len(pivots):
                return
            own = shard.docs[first[k] : first[k] + n[k]]
            to = np.minimum(np.searchsorted(own, pivots), n[k] - 1)
            score = score + np.where(own[to] == pivots, shard.impact[first[k] + to] * w[k], 0)
        can = score >= self.least
        if can.any():
            self.push(score[can], shard.ids[pivots[can]])


def _block(docs: DataFrame, block: list[tuple[int | None, list[bytes]]], k: int, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    vocabulary = sorted({t for _, ts in block for t in ts})
    place = {t: i for i, t in enumerate(vocabulary)}
    shards = scratch.write(build_shards(docs, vocabulary, id_col, text_col))
    n, total = (x or 0 for x in shards.agg(F.sum("docs"), F.sum("tokens")).first())
    held = shards.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.counts").alias("df"))
    weight = np.zeros(len(vocabulary), np.int64)
    for r in held.toLocalIterator():  # a row per term of the block at most
        weight[r.term] = math.floor(1000 * math.log((2 * n + 2) / (2 * r.df + 1)))
    asked = docs.sparkSession.sparkContext.broadcast(([i for i, _ in block], [np.array([place[t] for t in ts], np.int64) for _, ts in block], weight))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wanted, weight = asked.value
        weights = [weight[w] for w in wanted]
        best = [TopK(k) for _ in items]
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.slice(i, 1).to_pylist()[0], n, total, len(weight))
                if len(shard.ids):
                    for top, ts, w in zip(best, wanted, weights, strict=True):
                        if len(ts):
                            top.search(shard, ts, w)
        of = [i for i, top in zip(items, best, strict=True) for _ in top.ids]
        ids = [None if x == _NO_ID else int(x) for top in best for x in top.ids]
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(ids, pa.int64()), pa.array([int(x) for top in best for x in top.scores], pa.int64())], ["item_id", "doc_id", "score"])

    return scratch.write(shards.mapInArrow(search, "item_id long, doc_id long, score long"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of greatest score above 0, ties to the smaller id; all if fewer.

    Scores and terms are those of op13's contract, over whole texts, with counts over all documents; null and empty texts have no term.
    Rows that repeat an id are documents of their own; those without one come after the others in a tie. Rows that share an item id are one
    item; an item without a term has no row. An empty table gives no rows; other columns are not read.

    Items are read in blocks of bounded size, one unless there are very many; a block is broadcast and meets all documents. Their texts become
    shards of inverted lists with the block's terms, in the tasks that read them, so postings are never shuffled: a task searches its shards
    one after the other, with a heap per item whose threshold each shard starts from. What is shuffled is k rows per item and task, less
    those that the ranking drops before.
    """
    scratch = Scratch(docs.sparkSession, "search")
    rows = scratch.write(item_terms(items, item_id, item_text).filter(F.size("terms") > 0))
    n, size = rows.agg(F.count("*"), F.sum(F.size("terms"))).first()
    blocks = max(1, -(-n // block_items), -(-(size or 0) // block_terms))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
    found = None
    for at in range(blocks):
        block = [(r.item, [bytes(t) for t in r.terms]) for r in rows.filter(F.col("block") == at).toLocalIterator()]
        if block:
            part = _block(docs, block, k, id_col, text_col, scratch)
            found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    by_item = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
total AS (SELECT count(DISTINCT doc_id) AS n, count(*) AS l FROM t),
sizes AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * total.n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term, total.n),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * sizes.n * total.n) // total.l)))) AS BIGINT) AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), total GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
