import math
import re

from tablewright.llm.mixing import mix_sources


def targets_by_hand(sizes: dict) -> dict:
    """Shares and reshares as the rule says."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            return out | share
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def rows_of(n):
    out = []
    for i in range(n):
        source = None if i % 17 == 0 else ("hot" if i % 3 else f"s{i % 7}")
        out.append((i, None if i % 23 == 0 else " ".join(["w"] * (i * 7 % 41)), source, i))
    return out


def test_targets_and_taken(spark):
    data = rows_of(600)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, size long")
    out = {r.doc_id: r for r in mix_sources(docs).collect()}
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _, _ in data}
    sizes, by = {}, {i: s for i, _, s, _ in data}
    for i, n in words.items():
        sizes[by[i]] = sizes.get(by[i], 0) + n
    want, taken = targets_by_hand(sizes), dict.fromkeys(sizes, 0)
    for i, r in out.items():
        assert r.size == words[i] and r.source_size == sizes[by[i]]
        assert math.isclose(r.target, want[by[i]], rel_tol=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[by[i]] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 41
    assert {i: r.taken for i, r in out.items()} == {r.doc_id: r.taken for r in mix_sources(docs.repartition(7)).collect()}


def test_carry_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame(rows_of(100), "doc_id long, text string, source string, size long")
    out = mix_sources(docs, carry="copies")
    assert out.columns == ["doc_id", "text", "source", "size", "copies"]
    assert sorted(map(str, out.drop("copies").collect())) == sorted(map(str, docs.collect()))


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None), (None, "", None), (1, "a b", "x"), (1, "a b", "x")], schema)
    out = mix_sources(docs).collect()
    assert len(out) == 4 and sum(r.taken for r in out if r.source_size) <= 8
    assert all(r.target == 0 and r.taken == 0 for r in out if r.source_size == 0)
