"""Streams that remember: the state of each order by keyed state and timers, sessions of users, and changes whose order never came.

All three work by event time. A watermark says how late an event may be; what it passes is closed and forgotten, so state is bounded by
what is open. Rows later than that are dropped and counted (ingest.Totals.late).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from souk.operators.lifecycle import REACHED
from souk.plans import cleaning

#: State of keys, in a store that need not fit in memory.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_TIMES = [f"{s}_at" for s in REACHED]
#: Instants are microseconds.
_STATE = "status STRING, status_ts BIGINT, " + ", ".join(f"{t} BIGINT" for t in _TIMES)
#: Orders share a key of the store by hash, so a batch asks the store so many times at most, however many orders it changes. A bucket's
#: state grows with the open orders; the number is part of the state, so a stream keeps it.
BUCKETS = 32_768
_BUCKET = "timer BIGINT, order_ids ARRAY<STRING>, statuses ARRAY<STRING>, status_tss ARRAY<BIGINT>, " + ", ".join(f"{t}s ARRAY<BIGINT>" for t in _TIMES)
_TOLD = Row("order_id", "status", "status_ts", *_TIMES, "closed")
#: Where an order's values have the time of each status.
_PLACE = {s: i + 2 for i, s in enumerate(REACHED)}


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The session with a state store that keyed state needs, while streams are started."""
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def good_events(messages: DataFrame, delay: str) -> DataFrame:
    """Messages as judged events, without those that are rejected, and the watermark by event time (_at)."""
    judged = cleaning.judge_events(cleaning.parse_events(messages)).where("_reason is null")
    return judged.select("event_id", "event_type", "event_ts", "order_id", "status", F.col("event_ts").cast("timestamp").alias("_at")).withWatermark("_at", delay)


class OrderStates(StatefulProcessor):
    """Folds the changes of a bucket of orders, in any order and however often each comes, into each order's latest status and when each was first
    reached. An order that is left alone for some time is told once more, as closed, and forgotten.

    The store is asked once for a bucket, not for an order: its state is one array for each value, over its open orders, and its one timer is
    never later than the first of them is due."""

    def __init__(self, open_for_ms: int):
        self.open_for_ms = open_for_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("orders", _BUCKET)

    def _open(self) -> tuple[dict[str, list], int | None]:
        """The bucket's open orders (status, status_ts, times) and its timer."""
        known = self.state.get()
        return ({k: list(v) for k, *v in zip(*known[1:], strict=True)}, known[0]) if known else ({}, None)

    def _keep(self, orders: dict[str, list], timer: int | None, fired: bool = False) -> None:
        if not orders:
            self.state.clear()
            return
        due = min(v[1] for v in orders.values()) // 1000 + self.open_for_ms
        if timer is None or due < timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.state.update((timer, list(orders), *map(list, zip(*orders.values(), strict=True))))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        orders, timer = self._open()
        changed = {}
        for r in rows:
            name, status, us = r["order_id"], r["status"], r["us"]
            v = orders.get(name)
            if v is None:
                v = orders[name] = [status, us, *[None] * len(REACHED)]
            elif (us, status) > (v[1], v[0]):
                v[0], v[1] = status, us
            i = _PLACE[status]
            if v[i] is None or us < v[i]:
                v[i] = us
            changed[name] = v
        self._keep(orders, timer)
        for name, v in changed.items():
            yield _TOLD(name, *v, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        orders, timer = self._open()
        passed = expiredTimerInfo.getExpiryTimeInMs()
        if timer != passed:
            return
        now = max(passed, timerValues.getCurrentWatermarkInMs())
        closed = {k: v for k, v in orders.items() if v[1] // 1000 + self.open_for_ms <= now}
        self._keep({k: v for k, v in orders.items() if k not in closed}, None, fired=True)
        for name, v in closed.items():
            yield _TOLD(name, *v, True)

    def close(self) -> None:
        pass


def order_states(messages: DataFrame, delay: str, open_for_days: int = 90) -> DataFrame:
    """What is known of an order after each batch that changes it (update mode), and when it is closed. latest_states reads the
    result. Re-deliveries change nothing, so none are looked for."""
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(BUCKETS)).alias("bucket")
    changes = good_events(messages, delay).where(F.col("event_type") == cleaning.EVENT_TYPES[1]).select(bucket, "order_id", "status", F.unix_micros("_at").alias("us"), "_at")
    return changes.groupBy("bucket").transformWithState(OrderStates(open_for_days * 86_400_000), f"order_id STRING, {_STATE}, closed BOOLEAN", "Update", "EventTime")


def latest_states(told: DataFrame) -> DataFrame:
    """One row an order of all that order_states told. What was told before and after an order was forgotten is folded again."""
    instant = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    folded = told.groupBy("order_id").agg(F.max(F.struct("status_ts", "status")).alias("z"), *[F.min(t).alias(t) for t in _TIMES])
    return folded.select("order_id", F.col("z.status").alias("status"), instant("z.status_ts").alias("status_ts"), *[instant(t).alias(t) for t in _TIMES])


def sessions(stream: DataFrame, user: str, at: str, gap: str, delay: str) -> DataFrame:
    """(user, session_start, session_end, n) of each run of a user's events without a gap, once the watermark has passed it: sessions that
    a late event connects become one. session_end is the gap after the last event; an event at that very instant still belongs to it."""
    timed = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay)
    counted = timed.groupBy(F.session_window("_at", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(user, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def orphan_changes(messages: DataFrame, delay: str, within: str) -> DataFrame:
    """Status changes of orders of which no creation comes within the time before or after, told when the watermark shows that none
    can come any more. Both sides are kept only as long as the other may still send a match."""
    events = good_events(messages, delay).dropDuplicatesWithinWatermark(["event_id"])
    changes = events.where(F.col("event_type") == cleaning.EVENT_TYPES[1]).select("event_id", "order_id", "status", "_at")
    created = events.where(F.col("event_type") == cleaning.EVENT_TYPES[0]).select(F.col("order_id").alias("c_order"), F.col("_at").alias("c_at"))
    near = F.expr(f"order_id = c_order AND c_at >= _at - INTERVAL {within} AND c_at <= _at + INTERVAL {within}")
    return changes.join(created, near, "left_outer").where("c_order IS NULL").select("event_id", "order_id", "status")
