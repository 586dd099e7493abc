"""The daily jobs over a lake: each reads the layer before, commits its own in one manifest and returns a summary."""

from __future__ import annotations

import datetime as dt
import json
import os
import secrets
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.operators import calendar
from souk.plans import cleaning, flow, gold, graph, quality, status, warehouse
from souk.sources import csv_export, records, relational
from souk.sources.files import Files, stored
from souk.sources.lake import Lake
from souk.streaming import ingest

BUSINESS_ZONE = ZoneInfo("Europe/Paris")
#: The tables of each layer.
TABLES = {
    "bronze": ("customers", "products", "marketplace_orders", "order_events"),
    "silver": ("customers", "products", "order_events", "web_order_lines", "marketplace_order_lines", "rejects"),
    "gold": ("orders", "order_lines", "customers", "products"),
    "quality": ("check_results", "reject_history"),
}


class MissingTables(RuntimeError):
    """A job's input layer is not complete."""


class ChecksFailed(RuntimeError):
    """A quality check of severity error failed."""


def _env(name: str, default: str | None = None):
    return field(default_factory=lambda: os.environ.get(name, default))


@dataclass(frozen=True)
class Settings:
    root: str | None = _env("LAKE_ROOT")
    landing: str | None = _env("LANDING_ROOT")
    api: str | None = _env("SHOP_API_URL")
    servers: str | None = _env("KAFKA_BOOTSTRAP_SERVERS")
    topic: str = _env("KAFKA_TOPIC", "orders")
    #: A folder of messages as Parquet, read in place of a topic.
    messages: str | None = None
    #: The root of the lake, or the JDBC URL of the database, that takes the published gold tables; the driver's class of the latter.
    warehouse: str | None = _env("WAREHOUSE_ROOT")
    driver: str | None = _env("WAREHOUSE_DRIVER")
    #: The folder of the calendar's CSV files.
    seeds: str | None = _env("SEEDS_ROOT")


def new_run_id(now: dt.datetime | None = None) -> str:
    return f"{now or dt.datetime.now(dt.UTC):%Y%m%dT%H%M%SZ}-{secrets.token_hex(3)}"


def yesterday(now: dt.datetime | None = None) -> dt.date:
    return (now or dt.datetime.now(BUSINESS_ZONE)).astimezone(BUSINESS_ZONE).date() - dt.timedelta(days=1)


class Jobs:
    def __init__(self, spark: SparkSession, settings: Settings):
        if not settings.root:
            raise ValueError("no lake root is set")
        self.spark, self.settings, self.lake = spark, settings, Lake(spark, settings.root)
        self.events_path = f"{self.lake.root}/bronze/order_events"

    # tables

    def exists(self, name: str) -> bool:
        if name == "bronze/order_events":
            return any(n.startswith(f"{ingest.BATCH}=") for n in Files(self.spark).names(self.events_path))
        return self.lake.exists(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.events_path).drop(ingest.BATCH) if name == "bronze/order_events" else self.lake.read(name)

    def layer(self, layer: str) -> dict[str, DataFrame]:
        missing = [t for t in TABLES[layer] if not self.exists(f"{layer}/{t}")]
        if missing:
            raise MissingTables(f"{layer}: {', '.join(missing)}")
        return {t: self.read(f"{layer}/{t}") for t in TABLES[layer]}

    def _counts(self, names: Sequence[str]) -> dict[str, int]:
        return {n.split("/")[1]: self.lake.read(n).count() for n in names}

    # bronze

    def bronze_api(self, entities: Sequence[str] = tuple(records.FIELDS), full: bool = False, margin_minutes: int = 10, **options: object) -> dict:
        """options: of the paginated source."""
        began, run_id = time.time(), new_run_id()
        if not self.settings.api:
            raise ValueError("no address of the API is set")
        out = {e: records.load_versions(self.spark, self.lake, self.settings.api, e, f"{self.settings.landing}/api/{e}", run_id, full, margin_minutes, **options) for e in entities}
        return {"job": "bronze-api", "run_id": run_id, **out, "seconds": round(time.time() - began, 1)}

    def export_folder(self) -> str:
        return f"{self.settings.landing}/marketplace"

    def bronze_marketplace(self, first: dt.date | None = None, last: dt.date | None = None, every: bool = False, skip_missing: bool = False) -> dict:
        began, run_id = time.time(), new_run_id()
        if every:
            found = list(csv_export.available(self.spark, self.export_folder()))
            if not found:
                return {"job": "bronze-marketplace", "run_id": run_id, "files": 0, "seconds": round(time.time() - began, 1)}
            first, last, skip_missing = found[0], found[-1], True
        first = first or last or yesterday()
        last = last or first
        n = csv_export.load(self.spark, self.lake, self.export_folder(), first, last, run_id, skip_missing)
        return {"job": "bronze-marketplace", "run_id": run_id, "files": n, "first": str(first), "last": str(last), "seconds": round(time.time() - began, 1)}

    def bronze_events(self, continuous: bool = False, most_offsets: int = 100_000, interval_seconds: int = 15) -> dict:
        began, s = time.time(), self.settings
        stream = ingest.read_messages(self.spark, s.messages) if s.messages else ingest.read_topic(self.spark, s.servers, s.topic, most_offsets)
        every = f"{interval_seconds} seconds" if continuous else None
        told = ingest.append(ingest.to_bronze(stream), self.events_path, f"{self.lake.root}/_checkpoints/order_events", every, "order_events")
        return {"job": "bronze-events", "messages": told.rows, "batches": told.batches, "seconds": round(time.time() - began, 1)}

    # silver, gold

    def silver(self) -> dict:
        began, b = time.time(), self.layer("bronze")
        customers, customer_rejects = cleaning.customer_versions(b["customers"])
        products, product_rejects = cleaning.product_versions(b["products"])
        products = stored(products, "silver-products")
        events, event_rejects, again = cleaning.clean_events(b["order_events"])
        web, web_rejects = cleaning.web_order_lines(events, products)
        market, market_rejects = cleaning.marketplace_lines(b["marketplace_orders"], products)
        rejected = reduce(DataFrame.unionByName, [customer_rejects, product_rejects, event_rejects, web_rejects, market_rejects])
        names = ("customers", "products", "order_events", "web_order_lines", "marketplace_order_lines", "rejects")
        self.lake.publish({f"silver/{n}": df for n, df in zip(names, (customers, products, events, web, market, rejected), strict=True)}, plain=False)
        reasons: dict[str, dict[str, int]] = {}
        for r in self.lake.read("silver/rejects").groupBy("source", "reason").count().orderBy("source", "reason").collect():
            reasons.setdefault(r["source"], {})[r["reason"]] = r["count"]
        return {"job": "silver", "rows": self._counts([f"silver/{n}" for n in names]), "rejects": reasons, "duplicates_removed": again.count(), "seconds": round(time.time() - began, 1)}

    def gold(self) -> dict:
        began, s = time.time(), self.layer("silver")
        lines = s["web_order_lines"].unionByName(s["marketplace_order_lines"])
        self.lake.publish({"gold/orders": gold.orders(lines), "gold/order_lines": gold.order_lines(lines), "gold/customers": gold.customers(s["customers"]), "gold/products": gold.products(s["products"])})
        by_source = self.lake.read("gold/orders").groupBy("source").agg(F.count(F.lit(1)).alias("orders"), F.min("order_date").alias("first"), F.max("order_date").alias("last"), F.sum("total_amount").alias("total"))
        return {"job": "gold", "rows": self._counts([f"gold/{t}" for t in TABLES["gold"]]), "sources": {r["source"]: {k: str(r[k]) for k in ("orders", "first", "last", "total")} for r in by_source.collect()}, "seconds": round(time.time() - began, 1)}

    # quality

    def frames(self) -> dict[str, Callable[[], DataFrame]]:
        """What the checks look at, by name. A table that is missing fails its own checks only."""
        named = {f"{layer}.{t}": (lambda n=f"{layer}/{t}": self.read(n)) for layer in ("bronze", "silver", "gold") for t in TABLES[layer]}
        received = lambda: reduce(DataFrame.unionAll, [self.read(f"bronze/{t}").select(F.lit(t).alias("source")) for t in TABLES["bronze"]])
        return named | {"silver.reject_rates": lambda: quality.reject_rates(received(), self.read("silver/rejects"))}

    def quality(self, now: dt.datetime | None = None) -> dict:
        """Runs all checks and keeps their results and the rejects by reason as history."""
        began, run_id = time.time(), new_run_id(now)
        now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
        results = quality.run(self.spark, quality.checks(), self.frames(), run_id, now)
        self.lake.append(results, "quality/check_results")
        if self.exists("silver/rejects"):
            counted = self.lake.read("silver/rejects").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rejected"))
            self.lake.append(counted.select(F.lit(run_id).alias("run_id"), F.lit(now.isoformat(" ")).cast("timestamp_ntz").alias("checked_at"), "source", "reason", "rejected"), "quality/reject_history")
        rows = results.collect()
        tally: Mapping[str, int] = {state: sum(r["status"] == state for r in rows) for state in ("passed", "warning", "failed")}
        return {"job": "quality", "run_id": run_id, "checks": len(rows), **tally, "failures": [f"{r['layer']}.{r['table_name']}.{r['check_name']}" for r in rows if r["status"] == "failed"], "seconds": round(time.time() - began, 1)}

    def gate(self) -> dict:
        found = self.quality()
        if found["failed"]:
            raise ChecksFailed(", ".join(found["failures"]))
        return found

    # publication, overview

    def warehouse(self) -> Lake:
        return Lake(self.spark, self.settings.warehouse or f"{self.lake.root}/warehouse")

    def warehouse_load(self) -> dict:
        """Gold and quality tables into the warehouse, all in one commit: a lake of its own, or a database if its place is a JDBC URL."""
        began, frames = time.time(), dict(self.layer("gold"))
        frames |= {f"quality_{t}": self.read(f"quality/{t}") for t in TABLES["quality"] if self.exists(f"quality/{t}")}
        if (self.settings.warehouse or "").startswith("jdbc:"):
            driver = {"driver": self.settings.driver} if self.settings.driver else {}
            done = relational.Database(self.spark, self.settings.warehouse, driver).publish({f"lake.{n}": df for n, df in frames.items()})
            return {"job": "warehouse-load", "tables": done, "seconds": round(time.time() - began, 1)}
        target = self.warehouse()
        target.publish({f"raw/{n}": df.withColumn("_loaded_at", F.current_timestamp()) for n, df in frames.items()})
        return {"job": "warehouse-load", "rows": {f"raw/{n}": target.read(f"raw/{n}").count() for n in frames}, "seconds": round(time.time() - began, 1)}

    def raw(self) -> dict[str, DataFrame]:
        """The published tables. Quality tables that were never written are empty."""
        target = self.warehouse()
        empty = {"quality_check_results": quality.RESULT, "quality_reject_history": "run_id STRING, checked_at TIMESTAMP_NTZ, source STRING, reason STRING, rejected BIGINT"}
        missing = [t for t in TABLES["gold"] if not target.exists(f"raw/{t}")]
        if missing:
            raise MissingTables(f"warehouse: {', '.join(missing)}")
        return {t: target.read(f"raw/{t}") if target.exists(f"raw/{t}") else self.spark.createDataFrame([], empty[t]) for t in (*TABLES["gold"], *empty)}

    def seeds(self, orders: DataFrame) -> dict[str, DataFrame]:
        """Public holidays and sales events: CSV files with a header in the seeds' folder, or by rule for the years of the orders."""
        schemas = {"public_holidays": "holiday_date DATE, holiday_name STRING", "sales_events": "event_name STRING, start_date DATE, end_date DATE"}
        if self.settings.seeds:
            return {n: self.spark.read.csv(f"{self.settings.seeds}/{n}.csv", schema=x, header=True) for n, x in schemas.items()}
        years = calendar.years_of(orders, "order_date")
        return {"public_holidays": calendar.holidays(years), "sales_events": calendar.sales_events(years)}

    def warehouse_build(self, today: dt.date | None = None, full: bool = False) -> dict:
        """Builds the models that are stale, each stored before the next needs it, and runs the tests of all. Rows that fail a test are kept
        under test_failures, those of the generic tests in slices by test. Models are published before they are tested, as their readers see them."""
        began, raw, target, models = time.time(), self.raw(), self.warehouse(), warehouse.models()
        seeds = self.seeds(raw["orders"])
        marks, files = {n: graph.fingerprint(df) for n, df in (raw | seeds).items()}, Files(self.spark)
        state = f"{target.root}/_lineage/sources.json"
        before = {} if full or not files.names(state) else json.loads(files.read(state))
        stale = models.stale(marks, before, [n for n in models.order if target.exists(n)])
        made: dict[str, DataFrame] = {n: target.read(n) for n in models.order if n not in stale}
        for name in stale:
            made[name] = stored(models.models[name].make(raw | seeds | made), name.replace("/", "-"))
        target.publish({n: made[n] for n in stale} | {"lineage": self.spark.createDataFrame(models.edges(), "made_from STRING, name STRING, kind STRING")})
        files.delete(state)
        files.create(state, json.dumps(marks))
        made = {n: target.read(n) for n in models.order}
        frames = {n.replace("/", "."): (lambda d=df: d) for n, df in made.items()} | {f"lake.{n}": (lambda d=df: d) for n, df in raw.items()} | {f"seeds.{n}": (lambda d=df: d) for n, df in seeds.items()}
        now, tests = dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0), warehouse.tests()
        results = quality.run(self.spark, tests, frames, new_run_id(), now).collect()
        names = [f"{x.layer}.{x.table}.{x.name}" for x in tests]
        target.replace_slices(warehouse.quarantine(tests, frames, now), "test_failures/generic", "failed_test", names)
        failing = warehouse.failing_rows({n.split("/")[1]: (lambda df=df: df) for n, df in made.items()} | {"order_lines": lambda: raw["order_lines"]}, today or dt.datetime.now(BUSINESS_ZONE).date())
        target.publish({f"test_failures/{n}": rows() for n, rows in failing.items()})
        bad = {n: k for n in failing if (k := target.read(f"test_failures/{n}").count())}
        states = [r["status"] for r in results] + ["passed" if n not in bad else "warning" if n in warehouse.WARNINGS else "failed" for n in failing]
        failures = [f"{r['layer']}.{r['table_name']}.{r['check_name']}" for r in results if r["status"] == "failed"] + [n for n in bad if n not in warehouse.WARNINGS]
        return {"job": "warehouse-build", "built": list(stale), "models": {n: df.count() for n, df in made.items()}, "tests": len(states), **{x: states.count(x) for x in ("passed", "warning", "failed")}, "failures": failures, "seconds": round(time.time() - began, 1)}

    def warehouse_gate(self) -> dict:
        found = self.warehouse_build()
        if found["failed"]:
            raise ChecksFailed(", ".join(found["failures"]))
        return found

    def freshness(self, now: dt.datetime | None = None) -> dict:
        """How old the last load of each gold table in the warehouse is."""
        at = F.lit((now or dt.datetime.now(dt.UTC).replace(tzinfo=None)).isoformat(" ")).cast("timestamp_ntz")
        rows = warehouse.freshness({t: self.raw()[t] for t in TABLES["gold"]}, at).collect()
        return {"job": "freshness", "sources": {r["name"]: {"age_hours": r["age_hours"], "status": r["status"]} for r in rows}, "failed": sum(r["status"] == "error" for r in rows)}

    def freshness_gate(self) -> dict:
        found = self.freshness()
        if found["failed"]:
            raise ChecksFailed(", ".join(n for n, x in found["sources"].items() if x["status"] == "error"))
        return found

    def status(self, layers: Sequence[str] = tuple(TABLES)) -> list[dict]:
        """What each table holds."""
        names = [f"{layer}/{t}" for layer in layers for t in TABLES[layer]]
        return [{"table": n, "exists": True, **status.facts(self.read(n), n)} if self.exists(n) else {"table": n, "exists": False} for n in names]

    # the day

    def daily(self, day: dt.date | None = None, export_timeout: float = 7200.0) -> list[flow.Step]:
        """The steps of a business day: both bronze loads, messages if they have a place, silver, gold, the quality gate, and only then the
        warehouse, its models and how fresh it is."""
        day = day or yesterday()
        ready = lambda: day in csv_export.available(self.spark, self.export_folder())
        events = self.settings.messages or self.settings.servers
        loads = ("bronze_marketplace", "bronze_api", *(["bronze_events"] if events else []))
        return [
            flow.Step("export_ready", lambda: flow.wait_for(ready, timeout=export_timeout) or {"day": str(day)}, retries=0),
            flow.Step("bronze_marketplace", lambda: self.bronze_marketplace(day, day), ("export_ready",)),
            flow.Step("bronze_api", self.bronze_api),
            *([flow.Step("bronze_events", self.bronze_events)] if events else []),
            flow.Step("silver", self.silver, loads),
            flow.Step("gold", self.gold, ("silver",)),
            flow.Step("quality", self.gate, ("gold",), retries=0),
            flow.Step("warehouse_load", self.warehouse_load, ("quality",)),
            flow.Step("warehouse_build", self.warehouse_gate, ("warehouse_load",), retries=0),
            flow.Step("freshness", self.freshness_gate, ("warehouse_build",), retries=0),
        ]
