"""Nearest neighbours, spelling variants and ranked search against plain loops, over messy tables."""

import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import SCHEMA, frame, messy  # noqa: E402

from tablewright.llm import queries as llm  # noqa: E402
from tablewright.llm.lexical_search import Shard, TopK, ranked_search, terms  # noqa: E402
from tablewright.llm.spelling import near_words, runs, spelling_variants  # noqa: E402
from tablewright.llm.vector_search import Tile, nearest, quantise  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, rank int, score double, h1 long"


def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    hot = rows[7][1]
    rows += [(1000 + i, hot) for i in range(150)]  # a third have one vector, queries among them
    rows += [(2000 + i, [x + float(rng.normal()) * 1e-4 for x in hot]) for i in range(30)]
    rows += [(3000 + i, [2 * x for x in rows[i][1]]) for i in range(20)]
    rows += [(4000, None), (4010, []), (4020, [0.0] * 16), (4030, [math.nan] + hot[1:]), (4040, [math.inf] + hot[1:]), (4050, [None] + hot[1:]), (4060, [1e-30] * 16), (4070, [1.0, 2.0]), (4080, [2.0, 1.0]), (4090, [-1.0, 0.0])]
    rows += [(None, hot), (20, rows[20][1]), (20, rows[20][1]), (-40, rows[3][1])]
    return [(i, v, 1, 0.5, 2) for i, v in rows]


def nearest_by_hand(rows, k, every):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = [float(np.float32(x)) for x in v]

    def dot(a, b):
        s = 0.0
        for x, y in zip(a, b, strict=True):
            s += x * y
        return s

    length = {i: math.sqrt(dot(v, v)) for i, v in ok.items()}
    out = set()
    for q, v in ok.items():
        if q % every == 0:
            scored = sorted((-dot(v, w) / (length[q] * length[c]), c) for c, w in ok.items() if c != q and len(w) == len(v))[:k]
            out |= {(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("query_part", "row_part"), [(4096, 1 << 16), (5, 40)])
def test_nearest(spark, query_part, row_part, monkeypatch):
    monkeypatch.setattr("tablewright.llm.vector_search.LEAST_PART", row_part)
    df = spark.createDataFrame(vectors(), VECTORS).repartition(4)
    out = nearest(df, every=10, query_part=query_part, row_part=row_part).collect()
    assert {tuple(r) for r in out} == nearest_by_hand(vectors(), 5, 10) and len(out) == len(set(out))
    few = nearest(df.filter("vec_id in (4070, 4080, 4090)"), every=10).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in few} == {(4070, 1, 4080), (4070, 2, 4090), (4080, 1, 4070), (4080, 2, 4090), (4090, 1, 4070), (4090, 2, 4080)}
    assert nearest(df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_t(2, size=(400, 24))
    code, scale, err = quantise(x)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (code.astype(float) @ code.astype(float).T) * scale[:, None] * scale
    assert (np.abs(near - u @ u.T) <= err[:, None] + (1 + err)[:, None] * err + 1e-12).all()
    assert np.abs(near - u @ u.T).max() > 0.2 * err.max()


def test_tile_gives_survivors_away_when_full(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    code, scale, err = quantise(rng.normal(size=(500, 8)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(np.arange(500)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(err)], ["h1", "h2", "code", "scale", "err"])

    def found(held):
        monkeypatch.setattr("tablewright.llm.vector_search.HELD", held)
        monkeypatch.setattr("tablewright.llm.vector_search.CHUNK", 50)
        tile = Tile(6)
        tile.query(batch.slice(0, 20))
        return [r for b in [*tile.rows(batch), tile.settle()] for r in zip(*(b.column(c).to_pylist() for c in ("q1", "c1")), strict=True)]

    whole, parts = found(10**6), found(40)
    assert set(whole) <= set(parts) and len(parts) == len(set(parts))


def spelling_by_hand(rows, min_count, drop):
    n = Counter()
    for i, t, *_ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % drop == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= min_count}
    letters = sorted(set("".join(n)))
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def edits(w, letters):
    for i in range(len(w) + 1):
        for c in letters:
            yield w[:i] + c + w[i:]
            if i < len(w):
                yield w[:i] + c + w[i + 1 :]
        if i < len(w):
            yield w[:i] + w[i + 1 :]


def misspelt():
    rng = random.Random(5)
    words = ["".join(rng.choice("abÉé") for _ in range(rng.randint(5, 9))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ab" * 400, "ab" * 400 + "b", "abcdefgh"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(150)]
    # a chain of forms: each twice as frequent as the one before
    chain = ["qrstua", "qrstub", "qrstuvb", "qrxtuvb"]
    texts += [" ".join([w] * 3 * 3**k) + f" wörd ÷×{w}×" for k, w in enumerate(chain)]
    rows = [(i, t, "en", "s", 0, None, None, None, None) for i, t in enumerate(texts)]
    return rows + messy()


@pytest.mark.parametrize("partition", [20_000, 30])
def test_spelling(spark, partition):
    rows = misspelt()
    for drop in (97, 3):
        out = [tuple(r) for r in spelling_variants(frame(spark, rows), partition=partition, drop=drop).collect()]
        assert len(out) == len(set(out)) and set(out) == spelling_by_hand(rows, 3, drop)
    assert any(form and form != root for _, form, root, *_ in out)
    assert spelling_variants(frame(spark, [])).count() == 0


def test_runs_are_those_of_the_pattern():
    text = "AbÀ×÷ÿĀx\u0085y Z-\U0001f600qµw"
    assert [w.decode("latin-1") for w in runs(text)] == [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_near_words_by_edits():
    rng = random.Random(9)
    for _ in range(30):
        groups = [(g, "".join(rng.choice("abc") for _ in range(3 + (k % 2)))) for g in range(3) for k in range(20)]
        rows = sorted(set(groups))
        a, b = near_words(np.array([g for g, _ in rows]), [r.encode() for _, r in rows], np.full(len(rows), 3))
        got = [tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True)]
        want = {(i, j) for i, (g, x) in enumerate(rows) for j, (h, y) in enumerate(rows) if i < j and g == h and min(len(x), len(y)) == 3 and y in set(edits(x, "abc"))}
        assert len(got) == len(set(got)) and set(got) == want


ITEMS = "item_id long, text string, rank int, score long"


def search_by_hand(rows, items, k):
    docs = [(i, re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t, *_ in rows]
    docs = [(i, ts) for i, ts in docs if ts]
    n, total = len(docs), sum(len(ts) for _, ts in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    wanted = defaultdict(set)
    for i, text, *_ in items:
        wanted[i] |= {t.decode() for t in terms(text)}
    out = Counter()
    for item, ts in wanted.items():
        scored = []
        for i, own in docs:
            tf, m = Counter(own), 100 - 50 + (50 * len(own) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in ts if t in tf)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out.update((item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1))
    return out


def asked():
    rows = messy()
    items = [(i, rows[i * 3][1][:120], 1, 2) for i in range(25)] + [(50, rows[150][1], 1, 2), (51, "This very line is shared", 1, 2), (51, "ONE été", 1, 2), (52, None, 1, 2), (53, "", 1, 2), (54, "no such term zzz9", 1, 2), (None, rows[5][1], 1, 2), (55, " ".join(t for _, t, *_ in rows if t), 1, 2)]
    return items


@pytest.mark.parametrize(("shard", "block"), [(4096, 200_000), (7, 60)])
def test_search(spark, shard, block, monkeypatch):
    monkeypatch.setattr("tablewright.llm.lexical_search.SHARD_DOCS", shard)
    items = spark.createDataFrame(asked(), ITEMS)
    for k in (50, 3):
        out = ranked_search(frame(spark), items, k=k, block_terms=block).collect()
        assert Counter(tuple(r) for r in out) == search_by_hand(messy(), asked(), k)
    assert ranked_search(frame(spark, []), items).count() == 0 and ranked_search(frame(spark), items.limit(0)).count() == 0


def test_pivots_skip(monkeypatch):
    """Documents that can't reach the threshold aren't scored, and the result is that of scoring all."""
    rng = np.random.default_rng(4)
    n = 2000
    lists = [np.flatnonzero(rng.random(n) < p) for p in (0.9, 0.8, 0.5, 0.02, 0.01)]
    row = {"ids": list(range(n)), "sizes": [40] * n, "terms": list(range(5)), "counts": [len(x) for x in lists], "lists": np.concatenate(lists).astype(np.int32).tobytes(), "tfs": np.ones(sum(map(len, lists)), np.int32).tobytes()}
    weight = np.array([50, 100, 300, 4000, 5000])
    pushed = []
    push = TopK.push
    monkeypatch.setattr(TopK, "push", lambda self, s, i: (pushed.append(len(s)), push(self, s, i))[1])
    top = TopK(5)
    for _ in range(2):
        top.search(Shard(row, n, 40 * n, 5), np.arange(5), weight)
    score = np.zeros(n, np.int64)
    for x, w in zip(lists, weight, strict=True):
        score[x] += w * (1_000_000_000 // (1000 + 20 * 100))
    want = np.repeat(np.sort(score)[::-1][:5], 2)[:5]
    assert list(top.scores) == list(want) and pushed[1] < 50 < pushed[0]


def test_queries_over_tables(spark, tmp_path):
    docs = messy()
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(asked(), ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(vectors(), VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    q = {k.split("_")[0]: f for k, f in llm.queries().items()}
    found = {op: q[op](spark, str(tmp_path)) for op in ("op11", "op12", "op13")}
    assert found["op11"].dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    assert found["op12"].dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert found["op13"].dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert {tuple(r) for r in found["op11"].collect()} == nearest_by_hand(vectors(), 5, 50)
    assert {tuple(r) for r in found["op12"].collect()} == spelling_by_hand(docs, 3, 97)
    assert Counter(tuple(r) for r in found["op13"].collect()) == search_by_hand(docs, asked(), 50)
