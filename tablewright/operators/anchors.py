"""Values that go by a printed key: keys are looked up on every page at once, and each value is placed beside its key."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.shared import written
from ..sources.tables import table
from .pages import PAGE, values

_OTHER = re.compile(r"[^a-z0-9 ]+")
_MARKS = re.compile("[̀-ͯ҃-҉֑-ֽؐ-ًؚ-ٟऀ-ः᪰-᫿᷀-᷿⃐-⃿︠-︯]+")


def plain(text: str) -> str:
    """Lower case without accents, all but ASCII letters and digits as single spaces, none at the ends."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.lower()))
    return " ".join(_OTHER.sub(" ", text.lower()).split())


def plain_text(c: Column) -> Column:
    """plain as a Column function, a batch at a time."""
    return F.arrow_udf(lambda texts: pa.array([None if t is None else plain(t) for t in texts.to_pylist()], pa.string()), "string")(c)


class Keys:
    """Several texts that are looked for in one pass: hits come with the key's place, in order of their ends, and no two hits of one
    key overlap."""

    def __init__(self, keys: list[str]):
        self.sizes = [len(k) for k in keys]
        self.found = ahocorasick.Automaton()
        for i, k in enumerate(keys):
            if k:
                self.found.add_word(k, (*self.found.get(k, ()), i))
        if len(self.found):
            self.found.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(key, start, end)."""
        if not len(self.found):
            return
        free = [0] * len(self.sizes)
        for last, keys in self.found.iter(text):
            for k in keys:
                start = last + 1 - self.sizes[k]
                if start >= free[k]:
                    free[k] = last + 1
                    yield k, start, last + 1


def page_hits(words: list[dict], keys: Keys) -> list[tuple]:
    """As plain_hits, of words (text, x0, y0, x1, y1) as they are printed."""
    return plain_hits([(plain(w["text"] or ""), w["x0"], w["y0"], w["x1"], w["y1"]) for w in words], keys)


def plain_hits(words: list[tuple], keys: Keys) -> list[tuple]:
    """(key, hit, x0, y0, x1, y1): where keys stand on a page of words (plain text, x0, y0, x1, y1) in reading order. The plain texts of the words are one
    string; a hit's box spans the words it covers, of those at its ends as much as their share of letters."""
    held = [w for w in words if w[0]]
    starts, at = [], 0
    for w in held:
        starts.append(at)
        at += len(w[0]) + 1
    out, n = [], {}
    for k, a, b in keys.hits(" ".join([w[0] for w in held])):
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        box = None
        for i in range(first, last + 1):
            text, left, top, right, bottom = held[i]
            size = len(text)
            lo, hi = max(a, starts[i]), min(b, starts[i] + size)
            if lo < hi:
                wide = right - left
                x0, x1 = left + (lo - starts[i]) / size * wide, left + (hi - starts[i]) / size * wide
                box = (min(box[0], x0), min(box[1], top), max(box[2], x1), max(box[3], bottom)) if box else (x0, top, x1, bottom)
        if box and box[2] > box[0] and box[3] > box[1]:
            n[k] = n.get(k, -1) + 1
            out.append((k, n[k], *map(float, box)))
    return out


#: Texts whose plain form a task remembers.
KNOWN = 200_000


def find_keys(words: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, page, key, hit, x0, y0, x1, y1) of keys (doc, keys: an array of texts) on all pages of their document; keys are given as they are looked
    for, in plain text. A document's keys are a row before its words (with line and word_no), which are moved once and read in their order, a page at a
    time; a list of keys is compiled once in a row."""
    kinds = {c: words.schema[c].dataType.simpleString() for c in PAGE}
    at = ["page", "line", "word_no", "text", "x0", "y0", "x1", "y1"]
    marks = words.select("doc", *at, F.lit(None).cast("array<string>").alias("keys")).unionAll(keys.select("doc", *[F.lit(None).cast(words.schema[c].dataType).alias(c) for c in at], "keys"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        doc, page, texts, compiled, asked, held = None, None, None, Keys([]), None, []
        out: list[tuple] = []

        def settle() -> None:
            if held and texts is not None:
                out.extend((doc, page, texts[k], *rest) for k, *rest in plain_hits(held, compiled))
            held.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[] for _ in target]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, target, strict=True)], schema=target)

        for b in batches:
            for d, p, ks, t, *box in zip(*(values(b.column(c)) for c in ("doc", "page", "keys", "text", "x0", "y0", "x1", "y1")), strict=True):
                if d != doc or p != page:
                    settle()
                    if d != doc:
                        texts = None
                    doc, page = d, p
                if ks is not None:
                    texts = ks
                    if ks != asked:
                        asked, compiled = ks, Keys([k or "" for k in ks])
                elif texts is not None and t:
                    x = known.get(t)
                    if x is None:
                        if len(known) > KNOWN:
                            known.clear()
                        x = known[t] = plain(t)
                    held.append((x, *box))
            yield batch()
        settle()
        yield batch()

    full = f"doc {kinds['doc']}, page {kinds['page']}, key string, hit int, x0 double, y0 double, x1 double, y1 double"
    target = to_arrow_schema(StructType.fromDDL(full))
    return marks.filter("doc is not null").repartition("doc").sortWithinPartitions("doc", *at).mapInArrow(scan, full)


def anchor(text: Column) -> Column:
    """What a key is looked up by: its first four words after numbers at its start, as counts change from page to page; four numbers, if it has nothing else."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    named = F.transform(words, lambda w: ~w.rlike(r"^\d+[.,]?\d*$"))
    first = F.array_position(named, F.lit(True))
    return F.array_join(F.when(first > 0, F.slice(words, F.greatest(first, F.lit(1)).cast("int"), F.lit(4))).otherwise(F.slice(words, 1, 4)), " ")


def key_texts(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with the text in their key's box (doc, page, kx, ky, kw, kh in points) on its own page: words whose middle is in it by height and that lie in it
    by 40% of their width; null where there's none."""
    inside = F.least(F.col("x1"), F.col("kx") + F.col("kw")) - F.greatest(F.col("x0"), F.col("kx"))
    mid = (F.col("y0") + F.col("y1")) / 2
    met = pairs.select("pair", *PAGE, "kx", "ky", "kw", "kh").join(words, PAGE).filter(mid.between(F.col("ky"), F.col("ky") + F.col("kh")) & (inside >= (F.col("x1") - F.col("x0")) * 0.4))
    said = met.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"]), " ").alias("text"))
    return pairs.join(said, "pair", "left")


def anchor_values(words: DataFrame, pairs: DataFrame, pages: DataFrame, targets: DataFrame | None = None, tables: DataFrame | None = None, table_only: bool = False) -> DataFrame:
    """(pair, doc, page, x, y, width, height, how): where each pair's value lies on each page of the documents that take the pair's document as their template.

    pairs (pair, doc, page, kx, ky, kw, kh, vx, vy, vw, vh) are boxes of a key and its value, pages (doc, page, width, height), all in points. targets
    (source, doc) says which documents take which template; without it a document's other pages take its own. Pages that any of a document's pairs were
    drawn on are left out in it.

    A key's text is read and cut to its anchor; its hit nearest to where it was drawn (by squared distance of centres) gives the offset to the value. On a
    page, hits whose centre is within 0.35 of the page's width and 0.25 of its height from the key count, or all if there's none; of these the first
    in a table (tables: doc, page, t_x0, t_y0, t_x1, t_y1), else the first. The value's box is moved with it and cut to the page (how: match). Without a hit, or
    with table_only without one in a table, it stays where it was drawn (source). A key of less than two characters can't be looked up: its value is taken
    to the page of the same number only (absolute).
    """
    read = key_texts(words, pairs).withColumn("text", F.trim("text"))
    keyed = read.withColumn("key", F.when(F.char_length("text") >= 2, F.nullif(plain_text(anchor(F.col("text"))), F.lit(""))))
    targets = pairs.select(F.col("doc").alias("source"), "doc").distinct() if targets is None else targets.select("source", "doc")
    by_source = keyed.filter("key is not null").groupBy(F.col("doc").alias("source")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    wanted = targets.unionAll(pairs.select(F.col("doc").alias("source"), "doc")).distinct().join(by_source, "source").groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keys")))).alias("keys"))
    hits = find_keys(words, wanted)

    centre = lambda lo, hi: (F.col(lo) + F.col(hi)) / 2
    away = (centre("x0", "x1") - F.col("kx") - F.col("kw") / 2) ** 2 + (centre("y0", "y1") - F.col("ky") - F.col("kh") / 2) ** 2
    own = keyed.join(hits, [*PAGE, "key"]).groupBy("pair").agg(F.min_by(F.struct("x0", "y0"), F.struct(away, "hit")).alias("at"))
    tight = keyed.join(own, "pair", "left").withColumns({"sx": F.coalesce("at.x0", "kx"), "sy": F.coalesce("at.y0", "ky")})
    tight = tight.select("pair", F.col("doc").alias("source"), F.col("page").alias("from_page"), "key", "sx", "sy", "vx", "vy", "vw", "vh")

    drawn = pairs.select("doc", "page").distinct()
    to = tight.join(targets, "source").join(pages, "doc").join(drawn, PAGE, "left_anti").filter(F.col("key").isNotNull() | (F.col("page") == F.col("from_page")))
    near = (F.abs(centre("x0", "x1") - F.col("sx")) <= F.col("width") * 0.35) & (F.abs(centre("y0", "y1") - F.col("sy")) <= F.col("height") * 0.25)
    met = to.join(hits, [*PAGE, "key"])
    if tables is None:
        met = met.withColumn("boxed", F.lit(False))
    else:
        boxes = tables.groupBy(*PAGE).agg(F.collect_list(F.struct("t_x0", "t_y0", "t_x1", "t_y1")).alias("boxes"))
        within = F.exists("boxes", lambda b: centre("x0", "x1").between(b["t_x0"], b["t_x1"]) & centre("y0", "y1").between(b["t_y0"], b["t_y1"]))
        met = met.join(boxes, PAGE, "left").withColumn("boxed", F.coalesce(within, F.lit(False)))
    best = met.groupBy("pair", *PAGE).agg(F.min(F.struct((~near).alias("far"), (~F.col("boxed")).alias("loose"), "hit", "x0", "y0")).alias("m"))
    placed = to.join(best, ["pair", *PAGE], "left")
    if table_only:
        placed = placed.withColumn("m", F.when(~F.col("m.loose"), F.col("m")))
    hit = F.col("m").isNotNull()
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    moved = lambda v, m, s: F.when(hit, F.col(m) + F.col(v) - F.col(s)).otherwise(F.col(v))
    out = placed.withColumns({"x": clamp(moved("vx", "m.x0", "sx"), F.col("width")), "y": clamp(moved("vy", "m.y0", "sy"), F.col("height"))})
    cut = lambda size, at, most: F.when(hit, F.least(F.col(size), F.col(most) * 0.999 - F.col(at))).otherwise(F.col(size))
    out = out.select("pair", *PAGE, "x", "y", cut("vw", "x", "width").alias("width"), cut("vh", "y", "height").alias("height"), F.when(hit, "match").when(F.col("key").isNull(), "absolute").otherwise("source").alias("how"))
    return out.filter("width > 0 and height > 0")


#: A page of the customers' ledgers, in points.
WIDTH, HEIGHT = 612.0, 100.0


def ledgers(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as documents, their orders as pages: words (month at the left, quantity and price at the right edges of two columns) a line per line item, and
    pages."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order)).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    cell = lambda i, t, edge: F.struct(F.lit(i).alias("word_no"), t.alias("text"), F.lit(edge).alias("edge"))
    cells = F.array(cell(0, F.date_format("l_shipdate", "MMM"), 18.0), cell(1, F.col("l_quantity").cast("int").cast("string"), 150.0), cell(2, F.col("l_extendedprice").cast("decimal(18,2)").cast("string"), 250.0))
    w = li.select("doc", "page", "line", F.explode(cells).alias("c")).select("doc", "page", "line", "c.*").withColumn("y0", F.col("line") * 12.0)
    words = w.select("doc", "page", "line", "word_no", "text", (F.col("edge") - F.char_length("text") * 6).alias("x0"), "y0", F.col("edge").alias("x1"), (F.col("y0") + 10).alias("y1"))
    return words, o.select("doc", "page", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))


def anchor_values_query(spark, sf_dir: str) -> DataFrame:
    """On each customer's first page the first line's price is drawn as a value; its key is the month, for odd customers month and quantity, for every tenth a blank
    place. It is placed on the customer's other pages."""
    words, pages = ledgers(spark, sf_dir)
    words = written(words, "ledgers")  # read three times
    first = words.filter("page = 1 and line = 1 and word_no = 0")
    wide = F.when(F.col("doc") % 2 == 1, 150.0).otherwise(20.0)
    at = F.when(F.col("doc") % 10 == 0, 400.0).otherwise(0.0)
    pairs = first.select(F.col("doc").alias("pair"), "doc", "page", at.alias("kx"), F.col("y0").alias("ky"), wide.alias("kw"), F.lit(10.0).alias("kh"), F.lit(190.0).alias("vx"), F.col("y0").alias("vy"), F.lit(60.0).alias("vw"), F.lit(10.0).alias("vh"))
    out = anchor_values(words, pairs, pages)
    return out.select("pair", "doc", "page", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")], "how")


ANCHOR_VALUES = f"""WITH o AS (SELECT o_orderkey, o_custkey AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page FROM orders),
li AS (SELECT doc, page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS line, strftime(l_shipdate, '%b') AS month, CAST(CAST(trunc(l_quantity) AS INTEGER) AS VARCHAR) AS qty FROM lineitem JOIN o ON l_orderkey = o_orderkey),
p AS (SELECT doc, month, CASE WHEN doc % 2 = 1 THEN qty END AS qty, doc % 10 = 0 AS blank FROM li WHERE page = 1 AND line = 1),
hits AS (SELECT li.doc, li.page, line, CASE WHEN p.qty IS NULL THEN 9.0 ELSE (150 - 6 * (length(li.qty) - length(p.qty))) / 2.0 END AS cx, line * 12.0::DOUBLE AS y FROM li JOIN p USING (doc) WHERE NOT blank AND li.month = p.month AND (p.qty IS NULL OR starts_with(li.qty, p.qty))),
best AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY NOT (abs(cx) <= {WIDTH} * 0.35 AND abs(y + 5 - 12) <= {HEIGHT} * 0.25), line) AS k FROM hits),
t AS (SELECT p.doc AS pair, p.doc, o.page, b.y FROM p JOIN o USING (doc) LEFT JOIN best b ON b.doc = p.doc AND b.page = o.page AND b.k = 1 WHERE o.page > 1 AND NOT blank)
SELECT pair, doc, page, 190.0::DOUBLE AS x, least(coalesce(y, 12.0), {HEIGHT})::DOUBLE AS y, 60.0::DOUBLE AS width, CASE WHEN y IS NULL THEN 10.0 ELSE least(10.0, {HEIGHT} * 0.999 - y) END::DOUBLE AS height, CASE WHEN y IS NULL THEN 'source' ELSE 'match' END AS how FROM t WHERE y IS NULL OR y < {HEIGHT} * 0.999"""

QUERIES = {"anchor_values": (anchor_values_query, ANCHOR_VALUES)}
