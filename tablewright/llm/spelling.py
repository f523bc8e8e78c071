"""Spelling variants: a self-join of the vocabulary's trie by active nodes, in prefix partitions."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, table

MIN_CHARS = 5
MIN_COUNT = 3
RATIO = 2
#: Rows that a word's key must divide to lose a letter: the query's own perturbation of the texts.
DROP = 97
#: Words whose counts a task holds before it gives them away, about 30 MB.
WORDS = 200_000
#: Words of a prefix partition that stay together; a larger one is split again. A partition whose words differ in their last two letters
#: only has fewer.
PARTITION = 20_000
#: Letters, with padding, of the tries that a task grows at a time.
CELLS = 2_000_000

_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, in Latin-1; whatever has no place there is no letter."""
    return text.encode("latin-1", "replace").translate(_RUNS).split()


def count_words(docs: DataFrame, id_col: str, text_col: str, drop: int) -> DataFrame:
    """(word, n) over whole texts: the runs, less a letter where drop divides the crc32 of <id>:<run>. Null ids are written as nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in total]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for name, text in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for w, n in Counter(runs(text.as_py())).items():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                    if h % drop == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= MIN_CHARS:
                        total[w] = total.get(w, 0) + n
                if len(total) >= WORDS:
                    yield flush()
        yield flush()

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def partitions(rows: DataFrame) -> DataFrame:
    """Rows (path, rest, l, ...), where l is the length of the shorter rest of a pair, to two each: words that differ by one edit share the
    first half of the rest or, read backwards, the other half. The half goes to the path, which names the node of the forward or
    backward trie that both hang from."""
    half, other = F.ceil(F.col("l") / 2).cast("int"), F.floor(F.col("l") / 2).cast("int")
    back = F.reverse("rest")
    way = lambda mark, text, at: F.struct(F.concat("path", F.lit(mark), F.substr(text, F.lit(1), at)).alias("path"), F.substr(text, at + 1).alias("rest"), (F.col("l") - at).alias("l"))
    others = [c for c in rows.columns if c not in ("path", "rest", "l")]
    return rows.select(*others, F.explode(F.array(way(">", F.col("rest"), half), way("<", back, other))).alias("x")).select("x.path", "x.rest", "x.l", *others)


class Forest:
    """The tries of some partitions, one level of nodes at a time. rests are sorted within their group; level t has a node for each
    distinct (group, first t letters)."""

    def __init__(self, group: np.ndarray, rests: list[bytes]):
        self.size = np.fromiter(map(len, rests), np.int64, len(rests))
        self.depth = int(self.size.max(initial=0))
        self.letters = np.frombuffer(b"".join(r.ljust(self.depth, b"\0") for r in rests), np.uint8).reshape(len(rests), self.depth)
        self.new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.empty(0, bool)

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each level the parents of its nodes, their letters, and the words that end there (-1: none)."""
        new, inside, above = self.new.copy(), np.ones(len(self.new), bool), None
        for t in range(self.depth + 1):
            if t:
                c = self.letters[:, t - 1]
                new = new | np.concatenate([[True], c[1:] != c[:-1]])
                inside = self.size >= t
            first = np.flatnonzero(new & inside)
            node = np.cumsum(new & inside) - 1
            ends = np.flatnonzero(inside & (self.size == t))
            word = np.full(len(first), -1)
            word[node[ends[::-1]]] = ends[::-1]
            yield (above[first] if t else np.empty(0, np.int64)), (self.letters[first, t - 1] if t else np.empty(0, np.uint8)), word
            above = node


def _spread(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each i n[i] times, and beside it first[i], first[i] + 1, ..."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[i]


def near_words(group: np.ndarray, rests: list[bytes], shorter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words of one group whose rests differ by one edit, the shorter of them of length `shorter`; places in rests.

    A node's active nodes are those of its group at an edit distance of at most one. That of distance 0 is the node itself; those of
    distance 1 are kept as pairs: of one level (a letter was replaced) and of neighbouring levels (a letter was inserted, the other way
    round deleted). A level's pairs come from the one above: a pair goes on by equal letters, siblings become a pair, and a node
    becomes one with its child. Where both nodes of a pair end words, these are near.
    """
    same = np.empty((2, 0), np.int64)  # nodes of the last level
    across = np.empty((2, 0), np.int64)  # a node of the level before, one of the last level
    found = []
    words: list[np.ndarray] = []  # of each level's nodes: the word that ends there
    keys: list[np.ndarray] = []  # and its parent and letter, ascending
    for t, (parent, letter, word) in enumerate(Forest(group, rests).levels()):
        words.append(word)
        keys.append(parent * 256 + letter)
        if not t:
            continue
        start = np.searchsorted(parent, np.arange(len(words[t - 1])))
        n = np.searchsorted(parent, np.arange(len(words[t - 1])), "right") - start
        later = start[parent] + n[parent] - np.arange(len(parent)) - 1
        siblings = np.stack(_spread(np.arange(len(parent)) + 1, later))
        # children of u with the letter of a child of v
        i, u = _spread(start[same[0]], n[same[0]])
        v, there = _find(keys[t], same[1][i] * 256 + letter[u])
        same = np.concatenate([np.stack([u[there], v[there]]), siblings], axis=1)
        child = np.stack([parent, np.arange(len(parent))])
        if across.shape[1]:
            i, v = _spread(start[across[1]], n[across[1]])
            u, there = _find(keys[t - 1], across[0][i] * 256 + letter[v])
            child = np.concatenate([child, np.stack([u[there], v[there]])], axis=1)
        wide = max(len(parent), 1)
        across = np.stack(divmod(np.unique(child[0] * wide + child[1]), wide))
        for pairs, above in ((same, t), (across, t - 1)):
            a, b = words[above][pairs[0]], word[pairs[1]]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            found.append(np.stack([a, b])[:, shorter[a] == above])
        if t > 1:
            words[t - 2] = keys[t - 2] = np.empty(0, np.int64)
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
    return pairs[0].astype(np.int64), pairs[1].astype(np.int64)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def _joined(rows: DataFrame) -> DataFrame:
    """Rows (path, rest, l, word, n), sorted by path and rest, to near pairs (a, na, b, nb), a < b."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        cells, longest, last = 0, 0, None

        def grow() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            path = t["path"].to_pylist()
            group = np.cumsum([0] + [x != y for x, y in zip(path, path[1:], strict=False)])
            a, b = near_words(group, [r.encode("latin-1") for r in t["rest"].to_pylist()], t["l"].to_numpy())
            word, n = t["word"].to_pylist(), t["n"].to_numpy()
            swap = np.array([word[x] > word[y] for x, y in zip(a, b, strict=True)], bool)
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array([word[x] for x in a], pa.string()), pa.array(n[a], pa.int64()), pa.array([word[x] for x in b], pa.string()), pa.array(n[b], pa.int64())], ["a", "na", "b", "nb"])

        for b in batches:
            if not b.num_rows:
                continue
            path = b.column("path").to_pylist()
            size = np.array([len(r) for r in b.column("rest").to_pylist()])
            cuts = [0, *[i for i in range(1, len(path)) if path[i] != path[i - 1]], len(path)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                most = int(size[start:end].max())
                if path[start] != last and held and (cells + end - start) * (max(longest, most) + 1) > CELLS:
                    yield from grow()
                    cells, longest = 0, 0
                last = path[start]
                held.append(b.slice(start, end - start))
                cells, longest = cells + end - start, max(longest, most)
        if held:
            yield from grow()

    return rows.mapInArrow(join, "a string, na long, b string, nb long")


def near_pairs(vocabulary: DataFrame, scratch: Scratch, partition: int = PARTITION) -> DataFrame:
    """(word, n) to (a, na, b, nb), a < b: each two words that differ by one inserted, deleted or replaced letter, once."""
    length = F.char_length("word")
    placed = vocabulary.select("word", "n", F.col("word").alias("rest"), F.explode(F.array(length - 1, length)).alias("l")).filter("l > 0")
    rows = partitions(placed.withColumn("path", F.concat(F.col("l").cast("string"), F.lit(":"))))
    done = []
    while True:
        rows = scratch.write(rows)
        large = rows.groupBy("path").agg(F.count("*").alias("m")).filter(F.col("m") > partition).select("path")
        if large.isEmpty():
            done.append(rows)
            break
        large = scratch.write(large)
        done.append(rows.join(large, "path", "left_anti"))
        rows = partitions(rows.join(large, "path", "left_semi"))
    parts = []
    for r in done:
        parts.append(_joined(r.repartition("path").sortWithinPartitions("l", "path", "rest").select("path", "rest", "l", "word", "n")))
    pairs = parts[0]
    for p in parts[1:]:
        pairs = pairs.unionAll(p)
    return pairs.dropDuplicates(["a", "b"])


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT, ratio: int = RATIO, drop: int = DROP, partition: int = PARTITION) -> DataFrame:
    """(word, form, root, n, n_near, form_n), a row per word.

    Words are runs of Latin letters of whole texts (null and empty: none), less a letter here and there (see count_words), of at least
    MIN_CHARS letters and min_count occurrences over all documents; repeated rows count again. Two are near at edit distance one. A word's form is its
    near word of greatest n, ties to the least by code point, if that is at least ratio times its own n; its root is where its forms
    end. An empty table gives no rows; other columns are not read.

    Counts are summed in each task before they are shuffled. The vocabulary then meets itself in partitions of a forward and a backward trie: words
    hang from the node of their first half, and of their last half backwards, so that every near pair shares one of the two. A partition with more
    than `partition` words is split the same way at the rest of its words, as often as it takes; one letter being left bounds it. A task grows
    the tries of some partitions at a time and walks them level by level with each node's active nodes. Forms lead to ever
    greater n, so following them doubles its stride until nothing moves, in rounds logarithmic in the longest chain.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.write(count_words(docs, id_col, text_col, drop).filter(F.col("n") >= min_count))
    pairs = near_pairs(words, scratch, partition)
    both = F.explode(F.array(*[F.struct(F.col(a).alias("word"), F.col("n" + a).alias("n"), F.col(b).alias("near"), F.col("n" + b).alias("near_n")) for a, b in ("ab", "ba")])).alias("x")
    best = pairs.select(both).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    judged = words.join(best, "word", "left").withColumn("form", F.when(-F.col("best.m") >= ratio * F.col("n"), F.col("best.near")))
    judged = scratch.write(judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", F.when(F.col("form").isNotNull(), -F.col("best.m")).alias("form_n")))

    leads = scratch.write(judged.filter("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not leads.filter("moved").isEmpty():
        on = leads.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.write(leads.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        scratch.drop(leads)
        leads = new
    out = judged.join(leads.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE
bit AS (SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bit WHERE k = 8),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS raw FROM documents WHERE text IS NOT NULL),
runs AS (SELECT doc_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM found GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: unicode(x)),
  lambda c: CASE WHEN c < 128 THEN [CAST(c AS BIGINT)] ELSE [CAST(192 + c // 64 AS BIGINT), CAST(128 + c % 64 AS BIGINT)] END)) AS bs FROM runs),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda h, b: xor(h // 256, crc.t[xor(h, b) % 256 + 1])), CAST(4294967295 AS BIGINT)) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
gaps AS (SELECT word, n, i, concat(substr(word, 1, i), '*', substr(word, i + 2)) AS wild, concat(substr(word, 1, i), substr(word, i + 2)) AS less FROM words, unnest(range(length(word))) t(i)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.wild = b.wild AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM gaps a JOIN words b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM gaps a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, coalesce(form, word) AS at, form IS NULL AS over FROM forms
  UNION ALL SELECT walk.word, coalesce(f.form, walk.at), f.form IS NULL FROM walk JOIN forms f ON f.word = walk.at WHERE NOT over)
SELECT forms.word, form, walk.at AS root, n, n_near, form_n FROM forms JOIN walk ON walk.word = forms.word AND walk.over
"""
