"""Connected components of a graph given as edges, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) to (node, component): each node of an edge with the least node reachable from it.

    Alternates large-star and small-star steps: each node links its larger neighbours, then its smaller ones and itself,
    to the least of them. The edges end as stars, after a number of rounds logarithmic in the graph's size; every round is
    partial minima and equi-joins over the edges, written to the shared folder. Only two numbers come to the driver.
    """
    pairs = scratch.write(_oriented(edges))
    state = _state(pairs)
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = scratch.write(_oriented(large))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        new = scratch.write(_oriented(small))
        scratch.drop(pairs, large)
        pairs, before, state = new, state, _state(new)
        if state == before:
            break
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(pairs: DataFrame) -> tuple[int, int]:
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1] or 0
