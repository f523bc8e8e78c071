"""Stateful streams and the bucketed sink against plain loops."""

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.streaming.bucket_table import BucketTable, apply_changes
from tablewright.streaming.progress import Progress, watched
from tablewright.streaming.session_store import ROCKS, Sessions, session_changes, store_stats

USES = "store string, session string, seq long, used_at string, action string, bytes long"
START = datetime(2024, 1, 1)


def store_by_hand(uses, ttl, cap, sweep, until):
    """The store as a list in order of use, a tick of the sweeper at every multiple of sweep."""
    held, out, tick = [], [], 0.0

    def drop(s, event, at):
        held.remove(s)
        out.append((s[0], event, at))

    def sweeps(at):
        nonlocal tick
        while tick + sweep <= at:
            tick += sweep
            for s in sorted(held, key=lambda s: s[0]):
                if tick - s[1] > ttl:
                    drop(s, "expired", tick)

    for session, at, action in uses:
        sweeps(at)
        there = next((s for s in held if s[0] == session), None)
        if action == "remove":
            if there:
                drop(there, "removed", at)
        elif there and action != "add":
            held.remove(there)
            held.append(there)
        elif action == "get":
            out.append((session, "missed", at))
        else:
            if there:
                held.remove(there)
            for s in sorted(held, key=lambda s: s[0]):
                if at - s[1] > ttl:
                    drop(s, "expired", at)
            while len(held) >= cap:
                drop(held[0], "evicted", at)
            held.append((session, at))
            out.append((session, "added", at))
    sweeps(until)
    return out


def random_uses(n, seed, names):
    rng, at = random.Random(seed), 0.0
    out = []
    for _ in range(n):
        at += rng.choice([1, 7, 30, 200])
        out.append((rng.choice(names), at, rng.choices(["open", "get", "add", "remove"], [6, 2, 1, 1])[0]))
    return out


def test_sessions_by_hand():
    for seed in range(40):
        uses = random_uses(80, seed, "abcdefgh")
        store, got = Sessions(500.0, 4, 60.0), []
        for session, at, action in uses:
            got += [x[:3] for x in store.use(session, action, at, 1)]
        got += [x[:3] for x in store.expire(uses[-1][1] + 1000)]
        assert got == store_by_hand(uses, 500.0, 4, 60.0, uses[-1][1] + 1000)


def test_session_stream(spark, tmp_path):
    """Uses come out of order within a batch; the stream is started anew, from its checkpoint, for each batch; a timer takes what nobody uses any more."""
    uses = {s: random_uses(40, i, "abcdef") for i, s in enumerate(("one", "two"))}
    rows = [(s, x, k, str(START + timedelta(seconds=at)), action, 5) for s, us in uses.items() for k, (x, at, action) in enumerate(us)]
    rows.sort(key=lambda r: r[3])
    cut = len(rows) // 2
    end = START + timedelta(seconds=max(us[-1][1] for us in uses.values()) + 5000)
    batches = [rows[:cut], rows[cut:], *[[("three", "z", k, str(end), "open", 5)] for k in range(2)]]  # timers run once the watermark of the batch before has passed them
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        for i, b in enumerate(batches):
            random.Random(i).shuffle(b)
            spark.createDataFrame(b, USES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(USES).parquet(f"{tmp_path}/in")
            q = session_changes(stream, 500.0, 3, 60.0, "10 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    out = spark.read.parquet(f"{tmp_path}/out")
    got = sorted((r.store, r.session, r.event, (r.at - START).total_seconds()) for r in out.collect() if r.store != "three")
    until = (end - START).total_seconds() - 600
    want = sorted((s, *x) for s, us in uses.items() for x in store_by_hand(us, 500.0, 3, 60.0, until))
    assert got == want
    assert {"expired", "evicted", "removed", "missed"} <= {x[2] for x in got}
    # only the last batch's session is left
    assert [tuple(r) for r in store_stats(out, str(end + timedelta(seconds=30))).collect()] == [("three", 1, 5, 30)]


def stored(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_bucket_table(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", ["doc", "slot"], buckets=16, keep=2)
    schema = "doc long, slot int, seq long, value string"
    assert table.read() is None and table.versions() == []
    rng, want, sizes = random.Random(1), {}, []
    for version in range(6):
        batch = [(rng.randrange(400), rng.randrange(3), rng.randrange(1000), f"v{version}") for _ in range(600 if version == 0 else 2)]
        gone = [(rng.randrange(400), rng.randrange(3), rng.randrange(1000)) for _ in range(2)]
        best = {}
        for d, s, q, v in [*batch, *[(*g, None) for g in gone]]:
            for known in (best, want):
                if (d, s) not in known or (q, v is None, v or "") > (known[d, s][0], known[d, s][1] is None, known[d, s][1] or ""):
                    known[d, s] = (q, v)
        before = stored(tmp_path)
        # of one key and seq in a batch, any may be taken: keep the batch's best
        rows = [(d, s, q, v) for (d, s), (q, v) in best.items() if v is not None]
        dead = [(d, s, q) for (d, s), (q, v) in best.items() if v is None]
        apply_changes(table, spark.createDataFrame(rows, schema) if rows else None, spark.createDataFrame(dead, "doc long, slot int, seq long") if dead else None, version)
        apply_changes(table, spark.createDataFrame([(0, 0, 10**6, "replayed")], schema), None, version)
        got = {(r.doc, r.slot): (r.seq, r.value) for r in table.read().collect()}
        assert got == {k: x for k, x in want.items() if x[1] is not None}
        new = {f: n for f, n in stored(tmp_path).items() if f not in before and "/data/" in f}
        touched = {table.spark.range(1).select(F.pmod(F.xxhash64(F.lit(d).cast("long"), F.lit(s).cast("int")), F.lit(16))).first()[0] for d, s in best} if version else set(range(16))
        assert len(new) == len(touched) and table.versions() == list(range(max(0, version - 1), version + 1))
        sizes.append(sum(new.values()))
    assert max(sizes[1:]) < sizes[0] / 2
    old = table.read(table.versions()[0])
    assert old is not None and {r.value for r in old.collect()} <= {f"v{k}" for k in range(5)}
    # files that no version names are gone
    named = {f"v{v}/bucket={b}" for n in table.versions() for b, v in table.manifest(n).items()}
    assert {"/".join(f.split("/")[-3:-1]) for f in stored(f"{tmp_path}/t/data")} == named


def test_late_answer_after_deletion(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    put = lambda v, *rows: apply_changes(table, spark.createDataFrame(list(rows), "k int, seq long, x string"), None, v)
    put(0, (1, 5, "a"), (2, 5, "b"))
    apply_changes(table, None, spark.createDataFrame([(1, 7)], "k int, seq long").withColumn("x", F.lit(None).cast("string")), 1)
    put(2, (1, 6, "late"))
    assert {(r.k, r.x) for r in table.read().collect()} == {(2, "b")}
    put(3, (1, 8, "again"))
    assert {(r.k, r.x) for r in table.read().collect()} == {(1, "again"), (2, "b")}


def test_failed_batch_leaves_the_table(spark, tmp_path):
    table = BucketTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    rows = spark.createDataFrame([(1, 1, "a")], "k int, seq long, x string")
    table.merge(rows, 0)
    with pytest.raises(Exception, match="no"):
        table.merge(rows.withColumn("x", F.raise_error(F.lit("no"))), 1)
    assert table.versions() == [0] and [r.x for r in table.read().collect()] == ["a"]
    table.merge(rows.withColumn("seq", F.col("seq") + 1).withColumn("x", F.lit("b")), 1)
    assert [r.x for r in table.read().collect()] == ["b"]


def test_progress_equals_a_recount(spark, tmp_path):
    """The state after two runs of a stream, the second from its checkpoint, is what a count over the sink gives."""
    rng = random.Random(3)
    rows = [(f"d{rng.randrange(4)}", i, None if rng.random() < 0.8 else "unreadable") for i in range(120)]
    pages = {f"d{k}": sum(d == f"d{k}" for d, _, _ in rows) + k for k in range(3)}
    progress = Progress(pages)
    spark.streams.addListener(progress)
    try:
        for part in (rows[:50], rows[50:]):
            spark.createDataFrame(part, "doc string, page int, error string").repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema("doc string, page int, error string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            q = watched(stream, list(pages)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            assert q.awaitTermination(120)
        deadline = time.time() + 20
        while progress.state()["running"] and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(progress)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    count = lambda d, bad: sum((r.doc == d or d is None) and (r.error is not None) == bad for r in out)
    state = progress.state()
    assert len(out) == 120 and not state["running"] and state["error"] is None
    assert (state["done"], state["failed"]) == (count(None, False), count(None, True))
    assert state["documents"] == {d: (count(d, False), count(d, True), n - count(d, False) - count(d, True)) for d, n in pages.items()}
    assert [x[2] for x in state["documents"].values()] == [0, 1, 2]
