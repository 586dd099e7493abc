"""Sources, sinks and streams as queries: each writes to a new path in shared storage and returns what it then reads."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators import history, series
from souk.plans import status
from souk.plans.testdata import export_rows
from souk.queries.base import query
from souk.sources import csv_export, records
from souk.sources.files import scratch
from souk.sources.lake import Lake
from souk.streaming import ingest, stateful

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day FROM orders"


def _orders(s):
    return s.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"))


@query("scan_orders", f"SELECT o_orderkey, o_custkey, day FROM ({_ORDERS}) WHERE o_orderstatus = 'F' AND day >= DATE '1997-01-01'")
def _(s):
    return _orders(s).where("o_orderstatus = 'F' and day >= date'1997-01-01'").select("o_orderkey", "o_custkey", "day")


@query("append_table", _ORDERS)
def _(s):
    lake, df = Lake(s.spark, scratch(s.spark, "lake")), _orders(s)
    lake.append(df.where("o_orderstatus = 'F'"), "orders")
    lake.append(df.where("o_orderstatus <> 'F'"), "orders")
    return lake.read("orders")


@query("overwrite_table", f"SELECT o_orderkey, day FROM ({_ORDERS}) WHERE o_orderstatus = 'O'")
def _(s):
    lake, df = Lake(s.spark, scratch(s.spark, "lake")), _orders(s)
    lake.overwrite(df, "orders")
    lake.overwrite(df.where("o_orderstatus = 'O'").select("o_orderkey", "day"), "orders")
    return lake.read("orders")


@query("replace_day", f"SELECT o_orderkey, CASE WHEN day = DATE '1996-01-02' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, day FROM ({_ORDERS})")
def _(s):
    lake, df = Lake(s.spark, scratch(s.spark, "lake")), _orders(s).select("o_orderkey", "o_orderstatus", "day")
    day = F.col("day") == F.lit("1996-01-02").cast("date")
    lake.append(df.where(~day).repartition(int(s.spark.conf.get("spark.sql.shuffle.partitions")), "day"), "orders", "day")
    lake.replace_slices(df.where(day), "orders", "day")
    for _ in range(2):  # a repeated load changes nothing
        lake.replace_slices(df.where(day).withColumn("o_orderstatus", F.lit("new")), "orders", "day")
    return lake.read("orders")


@query("replace_condition", f"SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE o_orderstatus END AS o_orderstatus, day FROM ({_ORDERS})")
def _(s):
    lake, df = Lake(s.spark, scratch(s.spark, "lake")), _orders(s).select("o_orderkey", "o_orderstatus", "day")
    lake.append(df, "orders", "o_orderstatus")
    for _ in range(2):
        lake.replace_where(df.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("new")), "orders", "o_orderstatus", F.col("o_orderstatus").isin("P", "new"))
    return lake.read("orders")


@query("lake_status", """SELECT 'gold/orders' AS name, count(*) AS rows, 'first order date' AS fact, min(order_date)::VARCHAR AS value FROM gold_orders UNION ALL SELECT 'gold/orders', count(*), 'last order date', max(order_date)::VARCHAR FROM gold_orders
  UNION ALL SELECT 'gold/orders', count(*), 'total amount', sum(total_amount)::DECIMAL(22,2)::VARCHAR FROM gold_orders UNION ALL SELECT 'gold/order_lines', count(*), 'units sold', sum(quantity)::BIGINT::VARCHAR FROM gold_lines
  UNION ALL SELECT 'silver/customers', count(*), 'current customers', count_if(is_current)::BIGINT::VARCHAR FROM customer_versions UNION ALL SELECT 'silver/products', count(*), 'current products', count_if(is_current)::BIGINT::VARCHAR FROM product_versions""")  # fmt: skip
def _(s):
    """What the status job tells of some tables."""
    tables = {"gold/orders": s.gold_orders, "gold/order_lines": s.gold_lines, "silver/customers": s.customer_versions, "silver/products": s.product_versions}
    rows = [(name, told["rows"], fact, value) for name, df in tables.items() for told in [status.facts(df, name)] for fact, value in told.items() if fact != "rows"]
    return s.spark.createDataFrame(rows, "name STRING, rows BIGINT, fact STRING, value STRING")


@query("publish_gold", "SELECT source, count(*) AS orders FROM gold_orders GROUP BY source")
def _(s):
    lake = Lake(s.spark, scratch(s.spark, "lake"))
    lake.publish({"orders": s.gold_orders, "order_lines": s.gold_lines})
    return lake.read("orders").groupBy("source").agg(F.count(F.lit(1)).alias("orders"))


def _export_folder(s) -> str:
    """The folder with all of the export's daily files, written once a session."""
    if "export_folder" not in s.__dict__:
        folder = scratch(s.spark, "landing")
        csv_export.write(export_rows(s.spark, s.dir), folder)
        s.__dict__["export_folder"] = folder
    return s.__dict__["export_folder"]


def _loaded(s, first: dt.date | None = None, last: dt.date | None = None) -> DataFrame:
    """The days of the export from first to last, by default all it has, loaded into a lake."""
    lake, folder = Lake(s.spark, scratch(s.spark, "lake")), _export_folder(s)
    days = list(csv_export.available(s.spark, folder))
    csv_export.load(s.spark, lake, folder, first or days[0], last or days[-1], "run-1", skip_missing=True)
    return lake.read("bronze/marketplace_orders").select("numero_commande", "_file_date", F.col("_corrupt_record").isNotNull().alias("is_torn"), "ligne")


def _lineage(s, files) -> DataFrame:
    return csv_export.with_lineage(csv_export.read(s.spark, files), "run-1").groupBy("_source_file", "_file_date", "_run_id").agg(F.count(F.lit(1)).alias("n"))


@query("csv_ingest", "SELECT order_id AS numero_commande, file_date AS _file_date, torn AS is_torn, CASE WHEN torn THEN NULL ELSE line_number::VARCHAR END AS ligne FROM export_facts")
def _(s):
    return _loaded(s)


@query("csv_lineage", "SELECT 'marketplace_orders_' || file_date || '.csv' AS _source_file, file_date AS _file_date, 'run-1' AS _run_id, count(*) AS n FROM export_facts GROUP BY ALL")
def _(s):
    return _lineage(s, csv_export.available(s.spark, _export_folder(s)).values())


@query("missing_days", "SELECT d::DATE AS missing_day FROM (SELECT unnest(generate_series(min(file_date), max(file_date), INTERVAL 1 DAY)) AS d FROM export_facts) WHERE d::DATE NOT IN (SELECT file_date FROM export_facts)")
def _(s):
    """Over the export's own first to last day."""
    r = s.export_facts.agg(F.min("file_date").alias("first"), F.max("file_date").alias("last")).first()
    return series.missing_days(str(r["first"]), str(r["last"]), s.export_facts, "file_date")


@query("jsonl_ingest", "SELECT customer_id, email, updated_at FROM bronze_customers")
def _(s):
    path = scratch(s.spark, "landing")
    s.bronze_customers.select(F.to_json(F.struct(*records.FIELDS["customers"])).alias("value")).write.text(path)
    return records.read_lines(s.spark, path, "customers", "run-1").select("customer_id", "email", "updated_at")


@query("watermark", "SELECT strftime(max(TRY_CAST(updated_at AS TIMESTAMP)) - INTERVAL 10 MINUTE, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS updated_since FROM bronze_customers")
def _(s):
    return history.watermark(s.bronze_customers, "updated_at", 10)


@query("incremental_versions", "SELECT customer_id, updated_at FROM bronze_customers WHERE updated_at >= '1998-01-01' AND updated_at <> 'yesterday' AND (customer_id, updated_at) NOT IN (SELECT (customer_id, updated_at) FROM bronze_customers WHERE _ingested_at % 2 = 0)")
def _(s):
    b = s.bronze_customers.where("updated_at <> 'yesterday'")
    return history.only_new(b.where("updated_at >= '1998-01-01'"), b.where("_ingested_at % 2 = 0"), ["customer_id", "updated_at"]).select("customer_id", "updated_at")


def _arrivals(s) -> str:
    path = scratch(s.spark, "messages")
    s.bronze_events.withColumn("event_type", F.get_json_object("value", "$.event_type")).repartition(4).write.parquet(path)
    return path


_STREAM = ingest.MESSAGE + ", event_type STRING"


@query("stream_append", "SELECT count(*) + count_if(event_id % 100 = 7) AS messages, count_if(event_id % 100 = 7)::BIGINT AS again, count(DISTINCT event_id % 3) AS partitions FROM events")
def _(s):
    path, out, checkpoint = _arrivals(s), scratch(s.spark, "bronze"), scratch(s.spark, "checkpoint")
    for _ in range(2):  # a restart takes nothing twice
        ingest.append(ingest.to_bronze(ingest.read_messages(s.spark, path, 2, _STREAM)), out, checkpoint)
    return s.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("messages"), F.count_if(F.col("offset") % 2 == 1).alias("again"), F.count_distinct("partition").alias("partitions"))


@query("stream_replay", "SELECT count(*) + count_if(event_id % 100 = 7) AS messages, count(*) AS distinct_events FROM events")
def _(s):
    """Every batch of the stream reaches the sink twice, as when the stream dies before it commits; one copy stays."""
    path, out = _arrivals(s), scratch(s.spark, "bronze")
    sink = ingest.batch_sink(out, "replayed")

    def twice(df: DataFrame, number: int) -> None:
        sink(df, number)
        sink(df, number)

    stream = ingest.to_bronze(ingest.read_messages(s.spark, path, 1, _STREAM))
    ingest.run(s.spark, stream.writeStream.foreachBatch(twice).option("checkpointLocation", scratch(s.spark, "checkpoint")))
    return s.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct(F.floor(F.col("offset") / 2)).alias("distinct_events"))


@query("stream_dedup", "SELECT count(*) AS messages FROM events")
def _(s):
    path, out = _arrivals(s), scratch(s.spark, "bronze")
    keyed = ingest.read_messages(s.spark, path, 100, _STREAM).withColumn("key", F.floor(F.col("offset") / 2))
    ingest.append(ingest.drop_redeliveries(keyed, "key", "kafka_timestamp", "60 days"), out, scratch(s.spark, "checkpoint"))
    return s.spark.read.parquet(out).agg(F.count(F.lit(1)).alias("messages"))


@query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s):
    """All windows, as the last trigger leaves them: the memory sink holds days and types, not messages."""
    path, name = scratch(s.spark, "messages"), f"tumbling_{abs(hash(scratch(s.spark, 'x'))) % 10**9}"
    s.table("events").select("ts", "event_type").repartition(2).write.parquet(path)
    stream = s.spark.readStream.schema("ts TIMESTAMP_NTZ, event_type STRING").parquet(path)
    counted = ingest.tumbling_counts(stream, "ts", "1 day", ["event_type"], "60 days")
    ingest.run(s.spark, counted.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(s.spark, "checkpoint")))
    return s.spark.table(name)


#: Events arrive up to six hours out of order, so a day's delay loses none.
_DELAY, _DISORDER = "1 day", 7


def _in_turn(df: DataFrame, at: str, key: str, path: str, turns: int = 4) -> None:
    """Writes rows as files that come one after another, nearly by time: row by row up to six hours late. Rows without a time come first."""
    arrival = F.unix_micros(F.col(at).cast("timestamp")) + F.col(key) % _DISORDER * 3_600_000_000
    dated = df.withColumn("_arrival", F.coalesce(arrival, F.lit(-(2**62))))
    bounds = dated.agg(F.percentile_approx("_arrival", [i / turns for i in range(1, turns)])).first()[0] or []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        rows = dated if low is None else dated.where(F.col("_arrival") >= low)
        rows = rows if high is None else rows.where(F.col("_arrival") < high)
        rows.drop("_arrival").write.mode("append").parquet(path)


def _closing_messages(s) -> DataFrame:
    """A creation and a change of an order of its own, long after all others: they show the watermark that nothing comes any more."""
    last = s.bronze_events.agg(F.max("kafka_timestamp")).first()[0] + dt.timedelta(days=61)
    event = {"event_ts": last.isoformat() + "Z", "order_id": "~"}
    values = [{"event_id": "~1", "event_type": "order_created", "items": [{"line_number": 1}], **event}, {"event_id": "~2", "event_type": "order_status_changed", "status": "paid", **event}]
    return s.spark.createDataFrame([(json.dumps(v), "shop.orders", 0, -1 - i, last) for i, v in enumerate(values)], ingest.MESSAGE)


@query("stream_order_states", "SELECT order_id, status, status_ts, paid_at, shipped_at, delivered_at, cancelled_at, returned_at FROM event_states")
def _(s):
    """The state of every order by keyed state, over a restart in mid-stream; messages come late and again."""
    path, out, checkpoint = scratch(s.spark, "messages"), scratch(s.spark, "states"), scratch(s.spark, "checkpoint")
    odd = F.col("offset") % 3 == 0
    for part in (s.bronze_events.where(~odd), s.bronze_events.where(odd)):
        _in_turn(part, "kafka_timestamp", "offset", path, 2)
        states = stateful.order_states(ingest.read_messages(s.spark, path, 2), "90 days")
        with stateful.keyed_state(s.spark):
            ingest.append(states, out, checkpoint, mode="update")
    return stateful.latest_states(s.spark.read.parquet(out))


@query("stream_sessions", """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM (
  SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events)) GROUP BY user_id, nth""")  # fmt: skip
def _(s):
    """Sessions of users, thirty minutes apart, each told once the watermark has passed it."""
    path, out = scratch(s.spark, "messages"), scratch(s.spark, "sessions")
    events = s.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    _in_turn(events, "ts", "event_id", path)
    events.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("INTERVAL 61 DAYS")).alias("ts")).write.mode("append").parquet(path)
    stream = s.spark.readStream.schema("event_id BIGINT, user_id BIGINT, ts TIMESTAMP_NTZ").option("maxFilesPerTrigger", 2).parquet(path)
    ingest.append(stateful.sessions(stream, "user_id", "ts", "30 minutes", _DELAY), out, scratch(s.spark, "checkpoint"))
    return s.spark.read.parquet(out).drop(ingest.BATCH)


@query("stream_orphans", "SELECT event_id, order_id, status FROM event_good WHERE kind = 'order_status_changed' AND order_id NOT IN (SELECT order_id FROM event_created)")
def _(s):
    """Changes whose order was never created, by a join of two streams; an order's events lie within a day."""
    path, out = scratch(s.spark, "messages"), scratch(s.spark, "orphans")
    _in_turn(s.bronze_events, "kafka_timestamp", "offset", path)
    _closing_messages(s).write.mode("append").parquet(path)
    ingest.append(stateful.orphan_changes(ingest.read_messages(s.spark, path, 2), _DELAY, "1 DAY"), out, scratch(s.spark, "checkpoint"))
    return s.spark.read.parquet(out).drop(ingest.BATCH)
