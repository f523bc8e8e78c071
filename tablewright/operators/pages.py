"""Pages as runs of sorted rows: one narrow shuffle, one sort that can spill, and Arrow batches of plain columns."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

PAGE = ["doc", "page"]


def values(c: pa.Array) -> list:
    """A column's values; numbers and texts the fast way."""
    if pa.types.is_string(c.type):
        return c.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_floating(c.type) or pa.types.is_integer(c.type)):
        return c.to_pylist()
    if not c.null_count:
        return c.to_numpy().tolist()
    out = pc.fill_null(c, 0).to_numpy(zero_copy_only=False).astype(object)
    out[c.is_null().to_numpy(zero_copy_only=False)] = None
    return out.tolist()


def per_page(rows: DataFrame, solve: Callable[[list], list[tuple]], schema: str) -> DataFrame:
    """solve(page's rows, as tuples with a name for each column) for each page; schema follows doc and page. A page's rows come one after the other, so
    no task gathers more than one page."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in PAGE}
    columns = [c for c in rows.columns if c not in PAGE]
    full = f"doc {kinds['doc']}, page {kinds['page']}, {schema}"
    target = to_arrow_schema(StructType.fromDDL(full))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = partial(tuple.__new__, namedtuple("row", columns))  # noqa: PYI024
        key, held = None, []

        def batch(out: list[tuple], keys: list[tuple], counts: list[int]) -> pa.RecordBatch:
            at = np.repeat(np.arange(len(keys)), counts)
            pages = [pa.array([k[i] for k in keys], target.field(i).type).take(pa.array(at)) for i in (0, 1)]
            cols = list(zip(*out, strict=True)) or [[] for _ in range(len(target) - 2)]
            return pa.RecordBatch.from_arrays([*pages, *[pa.array(c, target.field(i + 2).type) for i, c in enumerate(cols)]], schema=target)

        for b in batches:
            if not b.num_rows:
                continue
            docs, numbers, *cols = [values(c) for c in b.columns]
            marks = list(map(named, zip(*cols, strict=True)))
            starts = np.flatnonzero(_fresh(b, 2)).tolist()
            out, keys, counts = [], [], []
            for i, j in zip(starts, [*starts[1:], len(marks)], strict=True):
                k = docs[i], numbers[i]
                if k != key:
                    if held:
                        solved = solve(held)
                        out += solved
                        keys.append(key)
                        counts.append(len(solved))
                    key, held = k, marks[i:j]
                else:
                    held += marks[i:j]
            yield batch(out, keys, counts)
        if held:
            solved = solve(held)
            yield batch(solved, [key], [len(solved)])

    return rows.select(*PAGE, *columns).repartition(*PAGE).sortWithinPartitions(*PAGE).mapInArrow(read, full)


def combined(rows: DataFrame, keys: list[str], how: dict[str, str]) -> DataFrame:
    """Rows of one Arrow batch with the same keys as one, other columns by how (min, max or sum), before Spark groups what is left of all batches: Spark sorts all
    rows to find a least text, and rows of a page lie beside each other where they are laid out."""
    flat = rows.select(*keys, *how)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b]).group_by(keys, use_threads=False).aggregate(list(how.items()))
            yield from t.select([*keys, *[f"{c}_{h}" for c, h in how.items()]]).rename_columns([*keys, *how]).combine_chunks().to_batches()

    each = flat.mapInArrow(read, flat.schema)
    return each.groupBy(*keys).agg(*[getattr(F, h)(c).alias(c) for c, h in how.items()])


def _fresh(b: pa.RecordBatch, keys: int) -> np.ndarray:
    """Where the first columns differ from the row before; true for the first row."""
    out = np.zeros(b.num_rows, bool)
    out[:1] = True
    for c in b.columns[:keys]:
        x, y = c.slice(1), c.slice(0, len(c) - 1)
        out[1:] |= pc.coalesce(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))).to_numpy(zero_copy_only=False)
    return out


def joined_texts(words: DataFrame, keys: list[str], order: list[str], separator: str = " ") -> DataFrame:
    """(keys, text): the texts of each group of a page's words, in order (then by text); keys begin with doc and page."""
    flat = words.select(*keys, *order, "text").repartition(*PAGE).sortWithinPartitions(*keys, *order, "text")
    target = StructType([*[flat.schema[k] for k in keys], StructField("text", StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(b: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
            texts, ends = b.column(b.num_columns - 1), np.append(starts[1:], b.num_rows)
            if texts.null_count:
                all_ = texts.to_pylist()
                joined = pa.array([separator.join(t for t in all_[i:j] if t is not None) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
            else:
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows), pa.int32()), texts), separator)
            at = pa.array(starts)
            return pa.RecordBatch.from_arrays([*[c.take(at) for c in b.columns[: len(keys)]], joined], [*keys, "text"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
            starts = np.flatnonzero(_fresh(t, len(keys)))
            last = int(starts[-1])
            if last:
                yield said(t.slice(0, last), starts[:-1])
            held = [t.slice(last)]
        if held:
            yield said(held[0], np.zeros(1, np.int64))

    return flat.mapInArrow(read, target)
