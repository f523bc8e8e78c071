import hashlib
import random
import string
import sys
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from fixtures import frame, messy  # noqa: E402

from tablewright.llm.exact_dedup import exact_dedup  # noqa: E402
from tablewright.llm.line_dedup import line_dedup  # noqa: E402
from tablewright.llm.near_dedup import Judge, near_duplicates, runs_needed  # noqa: E402

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_exact(spark):
    by = defaultdict(list)
    for i, t, *_ in messy():
        by[(t or "").translate(LOWER)].append(i)
    for small in (1 << 22, 64):  # a filter without room must give the same
        out = exact_dedup(frame(spark), digest_all=True, slots=small).collect()
        seen = Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out)
        want = Counter()
        for t, ids in by.items():
            keep = max((i for i in ids if i is not None), default=None)
            for i in ids:
                want[(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
        assert seen == want
        assert sum(r.kept for r in out) == len(by)
        assert all(r.doc_id == r.keep_id for r in out if r.kept)
    assert exact_dedup(frame(spark, [])).count() == 0


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(i)
    out = Counter()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= min_docs and i != max((h for h in holders[key(x)] if h is not None)))]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


def test_lines(spark):
    rows = messy()
    for batches in (1, 5):
        out = line_dedup(frame(spark), batches=batches).collect()
        assert Counter(tuple(r) for r in out) == lines_by_hand(rows)
    assert line_dedup(frame(spark, [])).count() == 0


def near_by_hand(rows, size, threshold=Fraction(4, 5)):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets.setdefault(i, set()).add(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(ids, 2):
        if any(a and b and Fraction(len(a & b), len(a | b)) >= threshold for a in sets[i] for b in sets[j]):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    return {i: root(i) for i in ids}


def test_near(spark):
    rows = messy()
    for size, block in ((2, 512), (2, 8), (5, 8)):  # small blocks meet pairwise, and deal a leader's members
        out = near_duplicates(frame(spark), shingle=size, block=block).collect()
        want = near_by_hand(rows, size)
        assert {r.doc_id: r.component_id for r in out if r.doc_id is not None} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in out)
        assert len(out) == len(rows)
    empties = {r.doc_id: r.n_shingles for r in out}
    assert empties[4000] == empties[4001] == empties[4002] == 0 and empties[4003] == 1
    assert near_duplicates(frame(spark, [])).count() == 0


def test_near_chains_and_far_members(spark):
    """A group whose members stray from the middle, so that its leader links only some: blocks find the other links."""
    rng = random.Random(3)
    base, rows = [f"b{k}" for k in range(120)], []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w), None, None, 0, None, None, None, None))
    want = near_by_hand(rows, 2)
    assert 1 < len(set(want.values())) < 150
    for block in (512, 16):
        assert {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), shingle=2, block=block).collect()} == want


def test_estimate_is_that_of_the_union_sketch():
    rng = random.Random(5)
    judge = Judge(Fraction(4, 5), 48, 23)
    for _ in range(300):
        pool = rng.sample(range(10**6), 150)
        x, y = (np.array(sorted(rng.sample(pool, rng.randint(49, 150)))) for _ in range(2))
        least = set(sorted({*x[:48].tolist(), *y[:48].tolist()})[:48])
        want = len(least & set(x[:48].tolist()) & set(y[:48].tolist())) >= 23
        got = judge._estimate(x[:48], [y[:48]], np.array([len(x) + len(y)]), np.array([max(len(x), len(y))]))
        assert got.tolist() == [want]
        inner = len(set(x.tolist()) & set(y.tolist()))
        sure = Fraction(inner, len(x) + len(y) - inner) >= Fraction(4, 5)
        assert judge.linked(x, [y]).tolist() == [sure and want and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y))]


def test_recall_of_planted_links():
    """Pairs of 300 shingles just at or above 0.8: the share that meets in some list and passes the estimate, over hashes."""
    rng, judge, missed, n = np.random.default_rng(7), Judge(Fraction(4, 5), 48, 23), 0, 4000
    for k in range(n):
        differ = 33 - k % 8  # similarity 0.802 to 0.84
        x = np.unique(rng.integers(0, 1 << 62, 300))
        y = np.sort(np.concatenate([rng.permutation(x)[differ:], rng.integers(0, 1 << 62, differ)]))
        runs = [{tuple(s[i : i + 3].tolist()) for i in range(46)} for s in (x, y)]
        missed += not (runs[0] & runs[1] and judge.linked(x, [y])[0])
    assert missed == 0


def test_near_small_sets_lose_nothing(spark):
    """Sets of 4 to 12 shingles, each against itself less or plus a word: links are all found, whatever the hashes."""
    rows = []
    for k in range(60):
        words = [f"w{k}x{j}" for j in range(5 + k % 9)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, "more"])), (10 * k + 2, " ".join(words[1:]))]
    rows = [(i, t, None, None, 0, None, None, None, None) for i, t in rows]
    out = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), shingle=2).collect()}
    assert out == near_by_hand(rows, 2)


def test_runs_needed_hold():
    """Every way to mark the differing values of a small union leaves a run of the promised length."""
    need = runs_needed(Fraction(4, 5), 48, 3)
    for u in range(5, 16):
        for d in range(1, u // 5 + 1):
            for gone in combinations(range(u), d):
                runs = "".join("." if i in gone else "s" for i in range(u)).split(".")
                longest = max(map(len, runs))
                assert any(longest >= r and all(n in need[r] for n in range(u - d, u + 1)) for r in need), (u, gone)
