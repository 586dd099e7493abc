"""Streams over hand-made messages: what a restart, a repeated batch, disorder and late rows do."""

import datetime as dt
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from souk.operators import lifecycle
from souk.streaming import ingest, stateful

T0 = dt.datetime(2026, 1, 1, 8)


def after(minutes):
    return T0 + dt.timedelta(minutes=minutes)


class Feed:
    """A folder of messages that come file by file."""

    def __init__(self, spark, base, schema=ingest.MESSAGE):
        self.spark, self.base, self.schema, self.path, self.n = spark, base, schema, str(base / "feed"), 0
        (base / "feed").mkdir()

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)
        time.sleep(0.02)

    def messages(self, *events):
        for e in events:
            self.n += 1
            e = {"event_id": f"e{self.n}", **e}
            self.send((json.dumps(e, default=lambda t: t.isoformat() + "Z"), "t", 0, self.n, e["event_ts"]))

    def stream(self, each=1):
        return ingest.read_messages(self.spark, self.path, each, self.schema)

    def at(self, name):
        return str(self.base / name)


def change(order, status, minutes, **more):
    return {"event_type": "order_status_changed", "order_id": order, "status": status, "event_ts": after(minutes), **more}


def created(order, minutes, **more):
    return {"event_type": "order_created", "order_id": order, "items": [{"line_number": 1}], "event_ts": after(minutes), **more}


def test_a_batch_that_was_written_but_not_committed_leaves_one_copy(spark, tmp_path):
    feed = Feed(spark, tmp_path, "n INT")
    for i in range(3):
        feed.send((i,), (i + 10,))
    sink, seen = ingest.batch_sink(feed.at("out"), "w"), []

    def dies(df, number):
        sink(df, number)
        seen.append(number)
        if len(seen) == 2:
            raise OSError("killed before the commit")

    start = lambda: ingest.run(spark, feed.stream().writeStream.foreachBatch(dies).option("checkpointLocation", feed.at("checkpoint")))
    with pytest.raises(Exception, match="killed"):
        start()
    assert spark.read.parquet(feed.at("out")).count() == 4
    told = start()
    out = spark.read.parquet(feed.at("out"))
    assert seen[1] == seen[2] and sorted(r["n"] for r in out.collect()) == [0, 1, 2, 10, 11, 12] and told.rows == 4
    other = ingest.append(feed.stream(9), feed.at("out"), feed.at("checkpoint2"), writer="other")
    assert other.rows == 6 and spark.read.parquet(feed.at("out")).count() == 12


def test_totals_cover_every_batch(spark, tmp_path):
    """More batches than a query remembers, and rows that came too late."""
    feed = Feed(spark, tmp_path, "k STRING, at TIMESTAMP")
    spark.createDataFrame([(str(i), after(i // 10)) for i in range(1040)], feed.schema).repartition(104).write.mode("append").parquet(feed.path)
    feed.send(*[(f"late{i}", after(-1000)) for i in range(7)])
    run = lambda: ingest.append(ingest.drop_redeliveries(feed.stream(), "k", "at", "3 hours"), feed.at("out"), feed.at("checkpoint"))
    told = run()
    assert (told.rows, told.late) == (1047, 7) and told.batches > 100 and spark.read.parquet(feed.at("out")).count() == 1040
    assert run().rows == 0


def test_a_continuous_stream_runs_until_it_is_stopped(spark, tmp_path):
    feed, out = Feed(spark, tmp_path, "n INT"), {}
    worker = threading.Thread(target=lambda: out.update(told=ingest.append(feed.stream(), feed.at("out"), feed.at("checkpoint"), every="200 milliseconds")))
    worker.start()
    for i in range(3):
        feed.send((i,))
        time.sleep(1.5)
    assert worker.is_alive()
    while spark.read.schema("n INT").parquet(feed.at("out")).count() < 3:
        time.sleep(0.2)
    for q in spark.streams.active:
        q.stop()
    worker.join(60)
    assert not worker.is_alive() and out["told"].rows == 3
    with pytest.raises(TimeoutError):
        ingest.append(feed.stream(), feed.at("out"), feed.at("checkpoint"), every="1 second", timeout=2)
    assert not spark.streams.active


def test_order_states_equal_the_batch_fold(spark, tmp_path):
    """Changes out of order, again, of equal times, broken ones among them; over a restart."""
    r = random.Random(3)
    changes = [change(f"o{r.randrange(12)}", r.choice(lifecycle.REACHED), r.randrange(300)) for _ in range(90)]
    changes += r.sample(changes, 20) + [change("o1", "lost", 5), change(None, "paid", 5), created("o2", 1)]
    r.shuffle(changes)
    rows = [(json.dumps({"event_id": f"e{i}", **c}, default=lambda t: t.isoformat() + "Z"), "t", 0, i, c["event_ts"]) for i, c in enumerate(changes)] + [("{cut", "t", 0, 999, T0)]
    feed = Feed(spark, tmp_path)
    with stateful.keyed_state(spark):
        for half in (rows[:60], rows[60:]):
            spark.createDataFrame(half, ingest.MESSAGE).repartition(3).write.mode("append").parquet(feed.path)
            ingest.append(stateful.order_states(feed.stream(2), "1 day"), feed.at("out"), feed.at("checkpoint"), mode="update")
    good = [(c["order_id"], c["status"], c["event_ts"]) for c in changes if c["order_id"] and c.get("status") in lifecycle.REACHED]
    expected = lifecycle.fold(spark.createDataFrame(good, "order_id string, status string, event_ts timestamp_ntz"))
    got = stateful.latest_states(spark.read.parquet(feed.at("out")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.select(got.columns).collect())) and got.count() == 12


def test_an_order_left_alone_is_closed_and_forgotten(spark, tmp_path):
    feed, day = Feed(spark, tmp_path), 1440
    states = lambda: stateful.order_states(feed.stream(1), "1 hour", open_for_days=2)
    with stateful.keyed_state(spark):
        feed.messages(change("a", "paid", 0), change("b", "paid", 10), change("a", "shipped", day))
        feed.messages(change("c", "paid", 3 * day + 200))
        ingest.append(states(), feed.at("out"), feed.at("checkpoint"), mode="update")
        told = spark.read.parquet(feed.at("out"))
        assert {(r["order_id"], r["status"]) for r in told.where("closed").collect()} == {("a", "shipped"), ("b", "paid")}
        # a comes back after it was forgotten, and once more too late to count
        feed.messages(change("b", "cancelled", 3 * day + 210), change("a", "delivered", 3 * day + 220), change("a", "returned", 60))
        late = ingest.append(states(), feed.at("out"), feed.at("checkpoint"), mode="update").late
    got = {r["order_id"]: r for r in stateful.latest_states(spark.read.parquet(feed.at("out"))).collect()}
    assert late == 1 and (got["a"]["status"], got["a"]["paid_at"], got["a"]["delivered_at"], got["a"]["returned_at"]) == ("delivered", after(0), after(3 * day + 220), None)
    assert (got["b"]["status"], got["b"]["paid_at"]) == ("cancelled", after(10)) and "providerClass" not in str(spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""))


def test_sessions_merge_and_close(spark, tmp_path):
    feed = Feed(spark, tmp_path, "u STRING, at TIMESTAMP_NTZ")
    run = lambda: ingest.append(stateful.sessions(feed.stream(), "u", "at", "30 minutes", "1 hour"), feed.at("out"), feed.at("checkpoint"))
    feed.send(("a", after(0)), ("b", after(5)), ("a", after(50)), (None, after(1)))
    feed.send(("a", after(25)), ("b", after(35)), ("b", after(66)))  # connects a's two sessions; b's second event comes when its session ends
    run()
    feed.send(("a", after(200)))
    run()
    feed.send(("a", after(20)), ("~", after(600)))  # too late
    assert run().late == 1
    got = {(r["u"], r["session_start"], r["session_end"], r["n"]) for r in spark.read.parquet(feed.at("out")).collect()}
    assert got == {("a", after(0), after(80), 3), ("b", after(5), after(65), 2), ("b", after(66), after(96), 1), (None, after(1), after(31), 1), ("a", after(200), after(230), 1)}


def test_changes_without_a_creation_are_told_when_none_can_come(spark, tmp_path):
    feed = Feed(spark, tmp_path)
    run = lambda: ingest.append(stateful.orphan_changes(feed.stream(), "1 hour", "3 HOURS"), feed.at("out"), feed.at("checkpoint"))
    feed.messages(change("a", "paid", 30), change("b", "paid", 31), change("b", "paid", 31, event_id="e2"), created("c", 0), change("c", "paid", 20))
    run()
    feed.messages(created("b", 40), change("c", "shipped", 100), change("c", "delivered", 400))
    run()
    feed.messages(created("~", 3000), change("~", "paid", 3000))
    run()
    got = sorted((r["order_id"], r["status"], r["event_id"]) for r in spark.read.parquet(feed.at("out")).collect())
    # b's creation came late; c's delivery is too far from its creation
    assert [x[:2] for x in got] == [("a", "paid"), ("c", "delivered")]
