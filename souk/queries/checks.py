"""Quality checks, warehouse tests and freshness as queries."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators.joins import flagged
from souk.plans import marts, measures, quality, warehouse
from souk.queries.base import VIEWS, Shop, _kept, both, query
from souk.queries.figures import share

#: The driver's tables lie in the past: checks run as of a fixed instant.
NOW = dt.datetime(2001, 8, 2, 12)
#: Order numbers and channels of the driver's tables.
ORDER_NUMBER = r"^[0-9]+-[0-9-]+$"


def _now():
    return F.lit(NOW.isoformat(" ")).cast("timestamp_ntz")


def _received(s) -> DataFrame:
    named = {"order_events": s.bronze_events, "marketplace_orders": s.bronze_export, "customers": s.bronze_customers, "products": s.bronze_products}
    frames = [df.select(F.lit(n).alias("source")) for n, df in named.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    return out


def _rejects(s) -> DataFrame:
    streams = [s.clean_events[1], s.web_lines[1], s.market_lines[1], s.customer_parts[1], s.product_parts[1]]
    out = streams[0].select("source", "reason")
    for x in streams[1:]:
        out = out.unionAll(x.select("source", "reason"))
    return out


def _frames(s) -> dict:
    """What the checks look at. Messages and versions count as loaded when they were written."""
    return {
        "bronze.order_events": lambda: s.bronze_events.withColumn("_ingested_at", F.col("kafka_timestamp")),
        "bronze.customers": lambda: s.bronze_customers.withColumn("_ingested_at", F.col("updated_at").try_cast("timestamp").cast("timestamp_ntz")),
        "bronze.marketplace_orders": lambda: s.bronze_export,
        "silver.customers": lambda: s.customer_versions,
        "silver.products": lambda: s.product_versions,
        "silver.order_events": lambda: s.clean_events[0],
        "silver.web_order_lines": lambda: s.web_lines[0],
        "silver.marketplace_order_lines": lambda: s.market_lines[0],
        "silver.reject_rates": lambda: quality.reject_rates(_received(s), _rejects(s)),
        "gold.orders": lambda: s.gold_orders,
        "gold.order_lines": lambda: s.gold_lines,
        "gold.customers": lambda: s.gold_customers,
        "gold.products": lambda: s.gold_products,
    }


#: The same tables in DuckDB SQL.
VIEWS |= {
    "q_events": "SELECT event_ts AS _ingested_at FROM event_facts",
    "q_customers": "SELECT TRY_CAST(updated_at AS TIMESTAMP) AS _ingested_at FROM bronze_customers",
    "q_exports": "SELECT file_date AS _file_date FROM export_facts",
    "q_silver_events": "SELECT event_id, order_id, event_ts, kind AS event_type, status FROM event_good",
    "q_web": "SELECT * FROM web_judged WHERE reason IS NULL",
    "q_market": "SELECT * FROM chain_lines WHERE source = 'marketplace'",
    "q_rates": """SELECT r.source, r.received, coalesce(j.n, 0)::BIGINT AS rejected, round(100.0 * coalesce(j.n, 0)::DOUBLE / r.received, 4) AS reject_rate_pct FROM (SELECT 'order_events' AS source, sum(CASE WHEN twice THEN 2 ELSE 1 END)::BIGINT AS received FROM event_facts
      UNION ALL SELECT 'marketplace_orders', count(*) FROM export_facts UNION ALL SELECT 'customers', count(*) FROM bronze_customers UNION ALL SELECT 'products', count(*) FROM bronze_products) r LEFT JOIN (SELECT source, sum(n) AS n FROM all_rejects GROUP BY source) j ON j.source = r.source""",
}
_DUCK = {
    "bronze.order_events": "q_events", "bronze.customers": "q_customers", "bronze.marketplace_orders": "q_exports", "silver.customers": "customer_versions", "silver.products": "product_versions", "silver.order_events": "q_silver_events",
    "silver.web_order_lines": "q_web", "silver.marketplace_order_lines": "q_market", "silver.reject_rates": "q_rates", "gold.orders": "gold_orders", "gold.order_lines": "gold_lines", "gold.customers": "gold_customers", "gold.products": "gold_products",
    "core.dim_date": "dim_dates", "core.dim_channels": "dim_channels", "core.dim_customers": "dim_customers", "core.dim_products": "dim_products", "core.fct_sales": "fct_sales", "core.fct_orders": "fct_orders", "marts.mart_daily_sales": "mart_daily",
    "marts.mart_customers": "mart_customers", "marts.mart_product_demand_features": "q_features", "marts.mart_data_quality": "q_quality", "marts.mart_reject_history": "mart_rejects", "lake.orders": "gold_orders", "lake.order_lines": "gold_lines",
    "lake.customers": "gold_customers", "lake.products": "gold_products", "seeds.sales_events": "q_sales", "seeds.public_holidays": "holidays",
}


def _condition(text: str) -> str:
    """A condition of the catalogue in DuckDB's SQL."""
    text = re.sub(r"(\w+) RLIKE ('[^']*')", r"regexp_matches(\1, \2)", text)
    inner = r"\(((?:[^()]|\([^()]*\))+)\)"
    text = re.sub(rf"age_minutes{inner}", rf"round(date_diff('second', \1, TIMESTAMP '{NOW}') / 60.0, 1)", text)
    return re.sub(rf"age_days{inner}", rf"date_diff('day', \1, DATE '{NOW:%Y-%m-%d}')", text)


def check_sql(x: quality.Check) -> str:
    """One check as a DuckDB query of its own over its table."""
    text = lambda t: f"'{t.replace(chr(39), chr(39) * 2)}'"
    frame, head = _DUCK[x.frame], f"'run-1' AS run_id, {text(x.expectation)} AS expectation, '{x.layer}' AS layer, '{x.table}' AS table_name, '{x.name}' AS check_name, '{x.dimension}' AS dimension, '{x.severity}' AS severity, '{x.says.replace(chr(39), chr(39) * 2)}' AS description"
    bad = "failed" if x.severity == "error" else "warning"
    if x.kind == "table":
        measure, sign, limit = re.fullmatch(r"(.+) (<=|>=) ([\d.]+)", _condition(x.text)).groups()
        return f"SELECT {head}, CASE WHEN v {sign} {limit} THEN 'passed' ELSE '{bad}' END AS status, NULL::BIGINT AS element_count, NULL::BIGINT AS unexpected_count, NULL::DOUBLE AS unexpected_percent, round(v, 4) AS observed, NULL::VARCHAR AS sample FROM (SELECT ({measure})::DOUBLE AS v FROM {frame})"
    if x.kind == "key":
        names, _, where = x.text.partition(" WHERE ")
        keys = names.split(", ")
        some = f"({' OR '.join(f'{k} IS NOT NULL' for k in keys)}){' AND ' + where if where else ''}"
        sample = "NULL::VARCHAR"
        counts = f"SELECT (SELECT count(*) FROM {frame}) AS n, coalesce(sum(k), 0)::BIGINT AS of, coalesce(sum(k) FILTER (WHERE k > 1), 0)::BIGINT AS bad FROM (SELECT count(*) AS k FROM {frame} WHERE {some} GROUP BY {names})"
    else:
        good = _condition(x.text)
        if x.kind == "found":
            column, parent, key = quality.reference(x.text)
            good = f"coalesce({column} IN (SELECT {key} FROM {_DUCK[parent]}), false)"
        counts = f"SELECT count(*) AS n, count({good}) AS of, count(*) FILTER (WHERE NOT ({good})) AS bad FROM {frame}"
        shown = f"SELECT v, ascii(md5(v)) % {quality.SAMPLES} AS class, row_number() OVER (PARTITION BY ascii(md5(v)) % {quality.SAMPLES} ORDER BY md5(v)) AS nth FROM (SELECT DISTINCT {quality.shown_name(x.text)}::VARCHAR AS v FROM {frame} WHERE NOT ({good})) WHERE v IS NOT NULL"
        sample = f"(SELECT left(to_json(list(v ORDER BY class))::VARCHAR, {quality.MOST_CHARACTERS}) FROM ({shown}) WHERE nth = 1)"
    return f"SELECT {head}, CASE WHEN bad * 100 <= {100 - x.percent} * of THEN 'passed' ELSE '{bad}' END AS status, n AS element_count, bad AS unexpected_count, round(CASE WHEN of > 0 THEN 100.0 * bad / of ELSE 0 END, 6)::DOUBLE AS unexpected_percent, NULL::DOUBLE AS observed, {sample} AS sample FROM ({counts})"


def _compared(results: DataFrame) -> DataFrame:
    """Results as the oracle has them: percent and observation as numbers."""
    kept = ("run_id", "layer", "table_name", "check_name", "dimension", "severity", "description", "expectation", "status", "element_count", "unexpected_count", "sample")
    return results.select(*kept, F.round("unexpected_percent", 6).alias("unexpected_percent"), F.round(F.col("observed_value").try_cast("double"), 4).alias("observed"))


VIEWS["all_checks"] = " UNION ALL ".join(map(check_sql, quality.checks(order_number=ORDER_NUMBER)))


def check_results(s, layers=("bronze", "silver", "gold")) -> DataFrame:
    todo = [x for x in quality.checks(order_number=ORDER_NUMBER) if x.layer in layers]
    return quality.run(s.spark, todo, _frames(s), "run-1", NOW)


Shop.check_results = _kept("check_results", check_results)
Shop.check_results.__set_name__(Shop, "check_results")
Shop.all_checks = property(lambda s: _compared(s.check_results))

for _name in ("quality_checks", "quality_checks_all"):
    query(_name, "SELECT * FROM all_checks")(lambda s: s.all_checks)

_MART = "SELECT 'run-1' AS run_id, TIMESTAMP '2001-08-02 12:00:00' AS checked_at, DATE '2001-08-02' AS checked_date, true AS is_latest_run, layer || '.' || table_name AS checked_table, status <> 'passed' AS is_problem, layer, table_name, check_name, dimension, severity, description, status, element_count, unexpected_count FROM all_checks"
VIEWS["q_quality"] = _MART
Shop.q_quality = property(lambda s: marts.data_quality(s.check_results))


@query("mart_data_quality", "SELECT * FROM q_quality")
def _(s):
    return marts.data_quality(s.check_results).drop("column_name", "unexpected_percent", "observed_value", "sample")


@query("fig_quality_cards", "SELECT max(checked_at) AS last_run, count(*) AS checks, count_if(status = 'passed')::BIGINT AS passed, count_if(status = 'warning')::BIGINT AS in_warning, count_if(status = 'failed')::BIGINT AS failed, round(100.0 * count_if(status = 'passed') / count(*), 1)::DOUBLE AS pass_rate FROM q_quality")
def _(s):
    r = marts.data_quality(s.check_results).where("is_latest_run")
    one = lambda x: F.count_if(F.col("status") == x)
    return r.agg(F.max("checked_at").alias("last_run"), F.count(F.lit(1)).alias("checks"), one("passed").alias("passed"), one("warning").alias("in_warning"), one("failed").alias("failed"), F.round(100 * one("passed") / F.count(F.lit(1)), 1).alias("pass_rate"))


@query("fig_quality_matrix", "SELECT layer, dimension, count(*) AS checks, count_if(is_problem)::BIGINT AS not_passed FROM q_quality GROUP BY layer, dimension")
def _(s):
    return marts.data_quality(s.check_results).where("is_latest_run").groupBy("layer", "dimension").agg(F.count(F.lit(1)).alias("checks"), F.count_if("is_problem").alias("not_passed"))


_DIMENSIONS = ("completeness", "consistency", "freshness", "uniqueness", "validity", "volume")


@query("quality_heatmap", f"SELECT layer, {', '.join(f'count_if(dimension = {d!r})::BIGINT AS {d}' for d in _DIMENSIONS)} FROM q_quality GROUP BY layer")
def _(s):
    """Layers by dimensions: how many checks there are."""
    return s.check_results.groupBy("layer").agg(*[F.count_if(F.col("dimension") == d).alias(d) for d in _DIMENSIONS])


@query(
    "check_search",
    """SELECT search, layer, table_name, check_name, status FROM all_checks, (VALUES ('not NULL', NULL), ('gold.order', NULL), ('unique', 'passed'), ('', 'failed'), ('no such check', NULL)) AS searches(search, wanted)
      WHERE (wanted IS NULL OR status = wanted) AND lower(layer || '.' || table_name || ' ' || check_name || ' ' || dimension || ' ' || description) LIKE '%' || lower(search) || '%' ESCAPE '!'""",
)
def _(s):
    """Some searches of the checks, each with what it finds."""
    out = None
    for text, status in (("not NULL", None), ("gold.order", None), ("unique", "passed"), ("", "failed"), ("no such check", None)):
        one = quality.search(s.check_results, text, status).select(F.lit(text).alias("search"), "layer", "table_name", "check_name", "status")
        out = one if out is None else out.unionAll(one)
    return out


@query("freshness", "SELECT check_name, status, observed FROM all_checks WHERE layer = 'bronze'")
def _(s):
    """How old the newest message, customer load and export file are."""
    return s.all_checks.where("layer = 'bronze'").select("check_name", "status", "observed")


_QUALITY_MEASURES = [n for n, m in measures.MEASURES.items() if m.table not in ("sales", "orders", "customers")]
_PASSED = "count_if(status = 'passed')"


@query(
    "measures_quality",
    f"""SELECT * FROM (SELECT count(*) AS checks, {_PASSED}::BIGINT AS checks_passed, count_if(status = 'warning')::BIGINT AS checks_in_warning, count_if(status = 'failed')::BIGINT AS checks_failed, {share(_PASSED, 'count(*)')} AS pass_rate, {share(_PASSED, 'count(*)')} AS run_pass_rate FROM all_checks),
      (SELECT sum(rejected)::BIGINT AS rejected_records FROM mart_rejects WHERE is_latest_run), (SELECT sum(rejected)::BIGINT AS rejected_records_per_run FROM mart_rejects)""",
)
def _(s):
    """The measures on checks and rejects: of the latest run, and of all."""
    checked, rejected = marts.data_quality(s.check_results), s.mart_rejects
    found = measures.evaluate(_QUALITY_MEASURES, {"latest_checks": checked.where("is_latest_run"), "checks": checked, "latest_rejects": rejected.where("is_latest_run"), "rejects": rejected})
    return found.select(*[F.round(n, 6).alias(n) if k == "double" else F.col(n) for n, k in found.dtypes])


@query("rejects_per_run", "SELECT run_id, sum(rejected)::BIGINT AS rejected_records_per_run FROM mart_rejects GROUP BY run_id")
def _(s):
    return measures.evaluate(["rejected_records_per_run"], {"rejects": s.mart_rejects}, by=["run_id"])


@query("reject_rates", "SELECT * FROM q_rates")
def _(s):
    return quality.reject_rates(_received(s), _rejects(s))


@query("ref_integrity", "SELECT count(*) AS n, count_if(o.order_id IS NULL)::BIGINT AS without_order, count_if(p.product_id IS NULL)::BIGINT AS without_product FROM gold_lines l LEFT JOIN gold_orders o ON o.order_id = l.order_id LEFT JOIN gold_products p ON p.product_id = l.product_id")
def _(s):
    checked = flagged(flagged(s.gold_lines, s.gold_orders, ["order_id"], "has_order"), s.gold_products, ["product_id"], "has_product")
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("has_order")).alias("without_order"), F.count_if(~F.col("has_product")).alias("without_product"))


# the warehouse's own tests

#: The star of the driver's tables has other channels than the shop.
_CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
VIEWS["q_features"] = "SELECT g.product_key, g.date_day, coalesce(d.units_sold, 0) AS units_sold FROM demand_grid g LEFT JOIN demand_sold d ON d.product_key = g.product_key AND d.order_date = g.date_day"
VIEWS["q_sales"] = "SELECT * FROM sales_windows"
VIEWS["all_tests"] = " UNION ALL ".join(map(check_sql, warehouse.tests(_CHANNELS)))


def _warehouse(s) -> dict:
    names = {
        "core.dim_date": "dim_dates", "core.dim_channels": "dim_channels", "core.dim_customers": "dim_customers", "core.dim_products": "dim_products", "core.fct_sales": "fct_sales", "core.fct_orders": "fct_orders", "marts.mart_daily_sales": "mart_daily",
        "marts.mart_customers": "mart_customers", "marts.mart_product_demand_features": "mart_features", "marts.mart_reject_history": "mart_rejects", "lake.orders": "gold_orders", "lake.order_lines": "gold_lines", "lake.customers": "gold_customers",
        "lake.products": "gold_products", "seeds.sales_events": "sales_windows", "seeds.public_holidays": "holidays",
    }
    return {k: (lambda n=v: getattr(s, n)) for k, v in names.items()} | {"marts.mart_data_quality": lambda: marts.data_quality(s.check_results)}


@query("warehouse_tests", "SELECT * FROM all_tests")
def _(s):
    """All generic tests of the warehouse's models, sources and seeds."""
    return _compared(quality.run(s.spark, warehouse.tests(_CHANNELS), _warehouse(s), "run-1", NOW))


def _failing_sql(x: quality.Check) -> str:
    """The rows that fail one generic test, as a DuckDB query of its own."""
    frame, head = _DUCK[x.frame], f"'{x.layer}' AS layer, '{x.table}' AS table_name, '{x.name}' AS check_name"
    names, _, where = x.text.partition(" WHERE ")
    about = names.split(", ") if x.kind == "key" else [quality.shown_name(x.text)]
    shown = " || ', ' || ".join(f"'{n}=' || coalesce({n}::VARCHAR, 'null')" for n in about)
    if x.kind == "key":
        some = f"({' OR '.join(f'{k} IS NOT NULL' for k in about)}){' AND ' + where if where else ''}"
        return f"SELECT {head}, {shown} AS shown FROM (SELECT *, count(*) OVER (PARTITION BY {names}) AS copies FROM {frame} WHERE {some}) WHERE copies > 1"
    good = _condition(x.text)
    if x.kind == "found":
        column, parent, key = quality.reference(x.text)
        good = f"coalesce({column} IN (SELECT {key} FROM {_DUCK[parent]}), false)"
    return f"SELECT {head}, {shown} AS shown FROM {frame} WHERE NOT ({good})"


#: Channels that the tests take for unknown, so that rows fail them too.
_FEWER = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query("test_failing_rows", " UNION ALL ".join(_failing_sql(x) for x in warehouse.tests(_FEWER) if x.kind != "table"))
def _(s):
    """Every row that fails one of the generic tests, orders of one channel among them."""
    return warehouse.quarantine(warehouse.tests(_FEWER), _warehouse(s), NOW).drop("record", "failed_test")


@query("test_failures", "SELECT 'order_steps' AS test_name, order_id AS failing_key FROM fct_orders WHERE shipped_at < order_ts OR delivered_at < shipped_at OR returned_at < delivered_at UNION ALL SELECT 'declared_totals', order_id FROM fct_orders WHERE abs(total_amount - source_total_amount) > lines_count * 0.01 UNION ALL SELECT 'no_future_order', order_id FROM fct_orders WHERE order_date > DATE '2001-08-03'")
def _(s):
    """The rows that fail the tests whose failures are kept."""
    names = {"fct_orders": "fct_orders", "fct_sales": "fct_sales", "order_lines": "gold_lines", "mart_daily_sales": "mart_daily", "mart_product_demand_features": "mart_features"}
    failing = warehouse.failing_rows({k: (lambda n=v: getattr(s, n)) for k, v in names.items()}, NOW.date())
    out = None
    for name in ("order_steps", "declared_totals", "no_future_order"):
        one = failing[name]().select(F.lit(name).alias("test_name"), F.col("order_id").alias("failing_key"))
        out = one if out is None else out.unionAll(one)
    return out


@query("source_freshness", """SELECT name, age_hours, CASE WHEN age_hours > 50 THEN 'error' WHEN age_hours > 26 THEN 'warn' ELSE 'pass' END AS status FROM (
  SELECT name, round(date_diff('minute', loaded, TIMESTAMP '2001-08-02 12:00:00') / 60.0, 1)::DOUBLE AS age_hours FROM (SELECT 'orders' AS name, max(order_ts) AS loaded FROM gold_orders UNION ALL SELECT 'order_lines', max(status_ts) FROM silver_lines
    UNION ALL SELECT 'customers', max(updated_at) FROM gold_customers UNION ALL SELECT 'products', max(updated_at) FROM gold_products))""")  # fmt: skip
def _(s):
    """How old the last load of each table of the lake is; here a row counts as loaded when it was changed."""
    loaded = {"orders": s.gold_orders.select(F.col("order_ts").alias("_loaded_at")), "order_lines": s.silver_lines.select(F.col("status_ts").alias("_loaded_at")), **{t: getattr(s, f"gold_{t}").select(F.col("updated_at").alias("_loaded_at")) for t in ("customers", "products")}}
    return warehouse.freshness(loaded, _now())


both("accepted_values", "SELECT order_status, count(*) AS n FROM {fct_orders} WHERE order_status NOT IN ('created', 'paid', 'shipped', 'delivered') GROUP BY order_status", "fct_orders")
both("accepted_range", "SELECT order_id, line_number, quantity, discount_pct FROM {fct_sales} WHERE quantity > 49 OR discount_pct NOT BETWEEN 0 AND 9", "fct_sales")
both("not_null_share", "SELECT round(count(customer_id) / CAST(count(*) AS DOUBLE), 6) AS customer_share, round(count(payment_method) / CAST(count(*) AS DOUBLE), 6) AS payment_share FROM {gold_orders}", "gold_orders")
both("unique_combination", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM {lineitem_rows} GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", "lineitem_rows")
_D = "CAST({} AS DECIMAL(18,2))".format
both("reconcile_daily_mart", f"SELECT a.net AS mart_net, b.net AS fact_net, a.units AS mart_units, b.units AS fact_units FROM (SELECT {_D('sum(net_sales)')} AS net, CAST(sum(units_sold) AS BIGINT) AS units FROM {{mart_daily}}) a CROSS JOIN (SELECT {_D('sum(net_sales_amount)')} AS net, CAST(sum(units_sold) AS BIGINT) AS units FROM {{fct_sales}}) b", "mart_daily", "fct_sales")
both("reconcile_orders_vs_lines", f"SELECT count(*) AS orders, count(*) FILTER (WHERE o.net_amount <> l.net OR o.units <> l.units) AS differ FROM {{fct_orders}} o LEFT JOIN (SELECT order_id, {_D('sum(net_amount)')} AS net, CAST(sum(quantity) AS BIGINT) AS units FROM {{fct_sales}} GROUP BY order_id) l ON l.order_id = o.order_id", "fct_orders", "fct_sales")
both("reconcile_fact_vs_lake", f"SELECT a.n AS lake_rows, b.n AS fact_rows, a.net AS lake_net, b.net AS fact_net FROM (SELECT count(*) AS n, {_D('sum(net_amount)')} AS net FROM {{gold_lines}}) a CROSS JOIN (SELECT count(*) AS n, {_D('sum(net_amount)')} AS net FROM {{fct_sales}}) b", "gold_lines", "fct_sales")
both("reconcile_no_future_order", "SELECT count(*) FILTER (WHERE order_date > DATE '2001-08-02') AS future_orders FROM {fct_orders}", "fct_orders")
both("reconcile_steps_in_order", "SELECT count(*) FILTER (WHERE shipped_at < order_ts) AS shipped_early, count(*) FILTER (WHERE delivered_at < shipped_at) AS delivered_early, count(*) FILTER (WHERE returned_at < delivered_at) AS returned_early FROM {fct_orders}", "fct_orders")
both("reconcile_declared_totals", "SELECT count(*) AS declared, count(*) FILTER (WHERE abs(total_amount - source_total_amount) > lines_count * CAST(0.01 AS DECIMAL(3,2))) AS differ FROM {gold_orders} WHERE source_total_amount IS NOT NULL", "gold_orders")
both("monitor_unknown_customers", "SELECT round(count(*) FILTER (WHERE customer_key = md5('_unknown_')) / CAST(count(*) AS DOUBLE), 6) AS unknown_share FROM {fct_orders}", "fct_orders")


@query("monitor_recent_order", "SELECT (DATE '2001-08-02' - max(order_date))::INT AS days_since_last_order FROM fct_orders")
def _(s):
    return s.fct_orders.agg(F.datediff(F.lit("2001-08-02").cast("date"), F.max("order_date")).alias("days_since_last_order"))


@query("reconcile_feature_grain", "SELECT count(*) AS rows, count(DISTINCT (product_key, date_day)) AS product_days FROM demand_grid")
def _(s):
    return marts.feature_grain(s.mart_stretches)


@query("reconcile_demand_units", "SELECT sum(d.units_sold)::BIGINT AS units FROM demand_grid g JOIN demand_sold d ON d.product_key = g.product_key AND d.order_date = g.date_day")
def _(s):
    return s.mart_stretches.agg(F.sum(F.col("units_sold") * marts.stretch_days()).alias("units"))
