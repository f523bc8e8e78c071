"""The session store as a stateful stream: time to live from creation, eviction of the least recently used, expiry by timer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGES = "store string, session string, event string, at timestamp, bytes long, n long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Sessions:
    """What one store holds: session to (created, used, place in the order of use, bytes). Times are seconds."""

    ttl: float
    cap: int
    sweep: float
    held: dict[str, tuple[float, float, int, int]] = field(default_factory=dict)
    place: int = 0

    def due(self, created: float) -> float:
        """The first tick of the sweeper at which a session is older than its time to live."""
        return (created + self.ttl) // self.sweep * self.sweep + self.sweep

    def expire(self, at: float) -> Iterator[tuple]:
        """What the sweeper's ticks up to a time have taken, in their order."""
        for due, s in sorted((self.due(x[0]), s) for s, x in self.held.items()):
            if due <= at:
                yield self._gone(s, "expired", due)

    def _gone(self, session: str, event: str, at: float) -> tuple:
        size = self.held.pop(session)[3]
        return session, event, at, size, len(self.held)

    def use(self, session: str, action: str, at: float, size: int) -> Iterator[tuple]:
        """add, get, remove, or open: get, and add what isn't there. Answers are changes (session, event, at, bytes, sessions left)."""
        yield from self.expire(at)
        there = self.held.get(session)
        if action == "remove":
            if there:
                yield self._gone(session, "removed", at)
        elif there and action != "add":
            self.place += 1
            self.held[session] = (there[0], max(there[1], at), self.place, there[3])
        elif action == "get":
            yield session, "missed", at, 0, len(self.held)
        else:
            self.held.pop(session, None)
            for s in sorted(s for s, x in self.held.items() if at - x[0] > self.ttl):
                yield self._gone(s, "expired", at)
            while len(self.held) >= self.cap:
                yield self._gone(min(self.held, key=lambda s: self.held[s][2]), "evicted", at)
            self.place += 1
            self.held[session] = (at, at, self.place, size)
            yield session, "added", at, size, len(self.held)


class StoreProcessor(StatefulProcessor):
    """Keeps each store's sessions as state, at most cap of them. A batch's uses are taken in order of (used_at, seq); an event-time timer at the next
    expiry takes sessions of a store that nobody uses, once the watermark has passed it."""

    def __init__(self, ttl: float, cap: int, sweep: float):
        self.ttl, self.cap, self.sweep = ttl, cap, sweep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getMapState("sessions", "session string", "created double, used double, place long, bytes long")
        self.kept = handle.getValueState("kept", "place long, timer long")

    def _load(self) -> Sessions:
        held = {k[0]: (v[0], v[1], v[2], v[3]) for k, v in self.sessions.iterator()}
        return Sessions(self.ttl, self.cap, self.sweep, held, self.kept.get()[0] if self.kept.exists() else 0)

    def _save(self, before: dict, now: Sessions, fired: bool) -> None:
        for s in before.keys() - now.held.keys():
            self.sessions.removeKey((s,))
        for s, x in now.held.items():
            if before.get(s) != x:
                self.sessions.updateValue((s,), x)
        timer = self.kept.get()[1] if self.kept.exists() and not fired else None
        due = min((int(now.due(x[0]) * 1000) for x in now.held.values()), default=None)
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.kept.update((now.place, due))

    @staticmethod
    def _out(key: tuple, changes: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], s, event, pd.Timestamp(at, unit="s"), size, n) for s, event, at, size, n in changes]
        return pd.DataFrame(rows, columns=["store", "session", "event", "at", "bytes", "n"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        uses = pd.concat(list(rows)).sort_values(["used_at", "seq"], kind="stable")
        store = self._load()
        before, changes = dict(store.held), []
        for u in uses.itertuples():
            changes += store.use(u.session, u.action, u.used_at.timestamp(), int(u.bytes))
        self._save(before, store, False)
        yield self._out(key, changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        store = self._load()
        before = dict(store.held)
        changes = list(store.expire(max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000))
        self._save(before, store, True)
        yield self._out(key, changes)

    def close(self) -> None:
        pass


def session_changes(uses: DataFrame, ttl: float, cap: int, sweep: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """Changes (store, session, event, at, bytes, n: sessions then held) of stores from a stream of their uses (store, session, seq, used_at, action,
    bytes): added, missed, removed, evicted (the least recently used makes room), expired (older than ttl seconds at a tick of the sweeper, or when one is added).

    Stores are independent, so they are dealt over tasks; a store's state has cap sessions at most. Uses later than the watermark are dropped, one that
    comes in a later batch than its successors is taken last. The state lives in RocksDB: ROCKS must be the session's state store provider.
    """
    uses = uses.select(F.col("store").cast("string").alias("store"), "session", F.col("seq").cast("long").alias("seq"), F.col("used_at").cast("timestamp").alias("used_at"), "action", F.col("bytes").cast("long").alias("bytes"))
    return uses.withWatermark("used_at", late).groupBy("store").transformWithStateInPandas(statefulProcessor=StoreProcessor(ttl, cap, sweep), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime")


def store_stats(changes: DataFrame, now: str) -> DataFrame:
    """(store, n_sessions, bytes, oldest_seconds) of what is held after all changes: sessions whose last change added them, with their age."""
    last = changes.filter("event <> 'missed'").groupBy("store", "session").agg(F.max_by(F.struct("event", "at", "bytes"), F.struct("at", F.col("event") == "added")).alias("x"))
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("x.at")
    return last.filter("x.event = 'added'").groupBy("store").agg(F.count("*").alias("n_sessions"), F.sum("x.bytes").alias("bytes"), F.max(age).alias("oldest_seconds"))
