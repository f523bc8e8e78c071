"""Nearest neighbours by a block matrix join: int8 product tiles with error bounds, exact cosines for what the bounds leave."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

NEIGHBOURS = 5
#: Ids divisible by this are queries.
EVERY = 50
#: Query vectors that a tile holds, and most and fewest rows that stream past them. Codes take a byte per component.
QUERY_PART, ROW_PART, LEAST_PART = 4096, 1 << 16, 4096
#: Rows of one matrix product; with QUERY_PART, its size is 16 MB.
CHUNK = 1024
#: Survivors that a tile holds before it gives some away.
HELD = 1_000_000
#: For the rounding of 32-bit scales and of the cosine itself.
SLACK = 2e-6
#: Salts of a vector that several queries have.
SALTS = 16


def usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite component, a length that is neither 0 nor beyond a double."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (norm2(v) > 0) & (norm2(v) < F.lit(float("inf"))), F.lit(False))


def norm2(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """In double precision, summed in the order of the components."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (F.sqrt(norm2(a)) * F.sqrt(norm2(b)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x to int8 codes of their directions, the codes' scales, and the length of what the codes leave out."""
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    scale = np.abs(u).max(1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((u - code * scale[:, None]) ** 2).sum(1))


def _coded(rows: DataFrame) -> DataFrame:
    """Rows (h1, h2, v) to (h1, h2, d, code, scale, err)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            size = v.value_lengths().to_numpy()
            flat, first = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(size)])
            out: list = [None] * len(v)
            scale, err = np.empty(len(v)), np.empty(len(v))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                codes, scale[at], err[at] = quantise(flat[first[at][:, None] + np.arange(d)])
                for i, c in zip(at, codes, strict=True):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), pa.array(size, pa.int32()), pa.array(out, pa.binary()), pa.array(scale), pa.array(err)], ["h1", "h2", "d", "code", "scale", "err"])

    return rows.select("h1", "h2", "v").mapInArrow(code, "h1 long, h2 long, d int, code binary, scale double, err double")


class Tile:
    """One part of the queries, which rows stream past. A heap per query keeps the `keep` greatest lower bounds seen; a row survives
    for a query while its upper bound reaches the least of them."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.held, self.n = keep, [], [], 0

    def query(self, b: pa.RecordBatch) -> None:
        self.parts.append(b)

    def _ready(self) -> None:
        t = pa.Table.from_batches(self.parts)
        self.h1, self.h2, self.scale, self.err = (t[c].to_numpy() for c in ("h1", "h2", "scale", "err"))
        self.codes = _codes(t["code"])
        self.heaps: list[list[float]] = [[] for _ in self.h1]
        self.least = np.full(len(self.h1), -np.inf)
        self.parts = []

    def rows(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._ready()
        for at in range(0, b.num_rows, CHUNK):
            part = b.slice(at, CHUNK)
            h1, h2, scale, err = (part.column(c).to_numpy() for c in ("h1", "h2", "scale", "err"))
            # products of int8 codes are whole numbers, which this sums without loss
            near = (self.codes @ _codes(part.column("code")).T).astype(np.float32)
            near *= self.scale.astype(np.float32)[:, None]
            near *= scale.astype(np.float32)
            most = (self.err[:, None] + (1 + self.err)[:, None] * err + SLACK).astype(np.float32)
            low = near - most
            k = min(self.keep, low.shape[1])
            for q in np.flatnonzero(low.max(1) > self.least):
                heap = self.heaps[q]
                for x in np.partition(low[q], -k)[-k:]:
                    if len(heap) < self.keep:
                        heappush(heap, x)
                    elif x > heap[0]:
                        heapreplace(heap, x)
                if len(heap) == self.keep:
                    self.least[q] = heap[0]
            q, c = np.nonzero(near + most >= self.least[:, None])
            self.held.append((q, h1[c], h2[c], low[q, c], (near[q, c] + most[q, c])))
            self.n += len(q)
            if self.n > HELD:
                self._prune()
                if self.n > HELD // 2:  # whatever else is found, these are judged later
                    yield self.settle()

    def _prune(self) -> None:
        q, *rest = (np.concatenate(x) for x in zip(*self.held, strict=True))
        stays = rest[-1] >= self.least[q]
        self.held = [tuple(x[stays] for x in (q, *rest))]
        self.n = int(stays.sum())

    def settle(self) -> pa.RecordBatch:
        if self.held:
            self._prune()
            q, c1, c2, low, high = self.held[0]
        else:
            q = c1 = c2 = np.empty(0, np.int64)
            low = high = np.empty(0)
        self.held, self.n = [], 0
        h1, h2 = (self.h1[q], self.h2[q]) if len(q) else (q, q)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (h1, h2, c1, c2)), pa.array(low.astype(float)), pa.array(high.astype(float))], ["q1", "q2", "c1", "c2", "low", "high"])


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Codes of one length as a matrix, in the least float type that sums their products without loss."""
    raw = b"".join(column.to_pylist())
    x = np.frombuffer(raw, np.int8).reshape(len(column), -1)
    return x.astype(np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64)


def _survivors(tiles: DataFrame, keep: int) -> DataFrame:
    """Rows (d, i, j, is_row, h1, h2, code, scale, err), sorted, a tile's queries first, to pairs (q1, q2, c1, c2, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for b in batches:
            of = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("d", "i", "j", "is_row")])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(0)) + 1), b.num_rows]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                *k, is_row = of[:, start]
                if k != key:
                    if tile:
                        yield tile.settle()
                    key, tile = k, Tile(keep)
                part = b.slice(start, end - start)
                if not is_row:
                    tile.query(part)
                elif tile.parts or hasattr(tile, "codes"):
                    yield from tile.rows(part)
        if tile:
            yield tile.settle()

    return tiles.mapInArrow(run, "q1 long, q2 long, c1 long, c2 long, low double, high double")


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, every: int = EVERY, id_col: str = "vec_id", vec_col: str = "embedding", query_part: int = QUERY_PART, row_part: int = ROW_PART) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id `every` divides, the k rows of other ids whose vectors have the greatest cosine,
    ties to the smaller id; all of them where they are fewer.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id; only vectors of one length are
    compared. Rows that repeat id and vector count once; an id with several vectors is found, and asks, by each. An empty table gives no rows;
    other columns are not read.

    1. Equal vectors are one class, named by a 128-bit hash. A class keeps its k + 1 least ids, all that an answer can need; they are
       picked before the shuffle, so a class with a third of all rows costs its tasks k + 1 rows each. Queries are classes too.
    2. Directions become int8 codes. With e the length of what a code leaves out, the product of two codes is off the cosine by at most
       e1 + (1 + e1) * e2.
    3. Parts of the queries meet parts of the rows in tiles, both dealt by hash; a tile multiplies blocks of codes. A heap per query keeps
       the k + 1 greatest lower bounds, and pairs whose upper bound is below the least of them go. No pair becomes a row before that.
    4. The tiles' bounds are merged for each query, the pairs left get their cosine in double precision, and the best k + 1 of each query's
       class are ranked. Every row is compared by its code, so nothing is missed: recall is 1.
    The work is queries times rows, as asked for; rows shuffled are rows times parts of queries and queries times parts of rows, a byte a component.
    """
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("v")).filter(F.col("_id").isNotNull() & usable(F.col("v")))
    rows = rows.select("_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    by_class = Window.partitionBy("h1", "h2").orderBy("_id")
    kept = rows.withColumn("_r", F.dense_rank().over(by_class)).filter(F.col("_r") <= k + 1)
    classes = scratch.write(kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("_id")).alias("ids"), F.first("v").alias("v")))
    asked = rows.filter(F.col("_id") % every == 0)
    queries = scratch.write(asked.groupBy("h1", "h2").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.first("v").alias("v")))
    n_rows, n_queries = classes.count(), queries.count()

    a = max(1, -(-n_queries // query_part))
    b = max(1, -(-n_rows // min(row_part, max(LEAST_PART, -(-n_rows // 32)))))
    part = lambda n: F.pmod(F.xxhash64(F.lit(7), "h1"), F.lit(n)).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = _coded(queries).withColumn("i", part(a)).withColumn("j", every_part(b)).withColumn("is_row", F.lit(False))
    streamed = _coded(classes).withColumn("j", part(b)).withColumn("i", every_part(a)).withColumn("is_row", F.lit(True))
    tiles = held.unionByName(streamed).repartition("d", "i", "j").sortWithinPartitions("d", "i", "j", "is_row").select("d", "i", "j", "is_row", "h1", "h2", "code", "scale", "err")
    found = scratch.write(_survivors(tiles, k + 1))

    by_query = Window.partitionBy("q1", "q2")
    bounds = found.withColumn("_r", F.row_number().over(by_query.orderBy(F.desc("low")))).filter(F.col("_r") <= k + 1)
    bounds = bounds.groupBy("q1", "q2").agg(F.when(F.count("*") > k, F.min("low")).alias("least"))
    pairs = found.join(bounds, ["q1", "q2"]).filter(F.col("least").isNull() | (F.col("high") >= F.col("least"))).select("q1", "q2", "c1", "c2")
    pairs = pairs.join(queries.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("v").alias("qv")), ["q1", "q2"])
    pairs = pairs.join(classes.select(F.col("h1").alias("c1"), F.col("h2").alias("c2"), "v", "ids"), ["c1", "c2"])
    scored = pairs.select("q1", "q2", cosine(F.col("qv"), F.col("v")).alias("score"), F.explode("ids").alias("_id"))
    best = scored.withColumn("_r", F.row_number().over(by_query.orderBy(F.desc("score"), "_id"))).filter(F.col("_r") <= k + 1)
    best = scratch.write(best.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("_r", "_id", "score"))).alias("best")))

    # a class with one query answers it at once; the answers of others are salted, so that a vector of many queries is dealt over tasks
    named = queries.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), "least", "most").join(best, ["q1", "q2"])
    one = named.filter("least = most").select(F.col("least").alias("_query"), "best")
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int").alias("salt")
    many = named.filter("least < most").select("q1", "q2", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asking = asked.select(F.col("h1").alias("q1"), F.col("h2").alias("q2"), F.col("_id").alias("_query"), salt).distinct()
    answers = one.unionAll(asking.hint("merge").join(many, ["q1", "q2", "salt"]).select("_query", "best"))
    others = F.slice(F.filter("best", lambda x: x["_id"] != F.col("_query")), 1, k)
    out = answers.select(F.col("_query").alias("query_id"), F.posexplode(others).alias("_at", "_x"))
    return out.select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_x._id").alias("vec_id"), F.col("_x.score").alias("score"))


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS length FROM v),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) / (q.length * c.length) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
