"""How queries are registered, the engine's tables over a folder of driver tables, and their equivalents in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

from souk.plans import cleaning, gold, marts, star, testdata
from souk.sources.files import Files, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _kept(name: str, build: Callable[[Shop], DataFrame]) -> cached_property:
    """A table that is built and stored when it is first used, as the engine's jobs store it."""
    return cached_property(lambda shop: stored(build(shop), name.replace("_", "-")))


def _parts(name: str, build: Callable[[Shop], tuple[DataFrame, ...]]) -> cached_property:
    """The same for a step that gives several tables: the first is stored, the others are views of what the step has stored itself."""

    def made(shop: Shop) -> tuple[DataFrame, ...]:
        first, *others = build(shop)
        return stored(first, name), *others

    return cached_property(made)


class Shop:
    """The engine's tables over a folder of driver tables. Each is stored once in a session, when it is first used; whatever
    is asked later reads it, as the warehouse's queries read what the daily jobs have built."""

    _open: ClassVar[dict[tuple[str, str, str], Shop]] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Shop:
        """The shop of this Spark application and folder, as its files are now."""
        key = (spark.sparkContext.applicationId, sf_dir, Files(spark).stamp(sf_dir))
        if key not in cls._open:
            cls._open[key] = cls(spark, sf_dir)
        cls._open[key].spark = spark
        return cls._open[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def shared(self, name: str) -> DataFrame:
        return testdata.shared(self.spark, self.dir, name)

    def __getattr__(self, name: str) -> DataFrame:
        if name in testdata.SHARED:
            return self.shared(name)
        raise AttributeError(name)

    lineitem_rows = cached_property(lambda s: s.table("lineitem").select("l_orderkey", "l_linenumber"))
    silver_lines = _kept("silver_lines", lambda s: testdata.shared(s.spark, s.dir, "silver_lines", lineitem="l_orderkey", orders="o_orderkey"))
    # a view of silver: its amounts are three products
    gold_lines = cached_property(lambda s: gold.order_lines(s.silver_lines))
    gold_orders = _kept("gold_orders", lambda s: gold.orders(s.silver_lines))
    customer_parts = _parts("customers", lambda s: cleaning.customer_versions(s.bronze_customers))
    product_parts = _parts("products", lambda s: cleaning.product_versions(s.bronze_products))
    customer_versions = cached_property(lambda s: s.customer_parts[0])
    product_versions = cached_property(lambda s: s.product_parts[0])
    gold_customers = _kept("gold_customers", lambda s: gold.customers(s.customer_versions))
    gold_products = _kept("gold_products", lambda s: gold.products(s.product_versions))
    dim_dates = _kept("dim_dates", lambda s: star.dates(s.gold_orders, s.holidays, s.sales_windows))
    dim_channels = _kept("dim_channels", lambda s: star.channels(s.gold_orders))
    dim_customers = _kept("dim_customers", lambda s: star.customers(s.gold_customers))
    dim_products = _kept("dim_products", lambda s: star.products(s.gold_products))
    # stored without its hashed row key, which is half of its bytes
    fct_facts = _kept("fct_sales", lambda s: star.sales(s.gold_lines, s.gold_orders, s.dim_customers, s.dim_products).drop("sale_key"))
    fct_sales = cached_property(lambda s: s.fct_facts.select(star.sale_key(), "*"))
    fct_orders = _kept("fct_orders", lambda s: star.order_facts(s.gold_orders, s.dim_customers))
    mart_daily = _kept("mart_daily", lambda s: marts.daily_sales(s.fct_sales, s.dim_products, s.dim_dates))
    mart_customers = _kept("mart_customers", lambda s: marts.customer_history(s.fct_orders, s.dim_customers))
    # a row for each product and day: not stored, so that a query makes only the columns that it asks for
    mart_features = cached_property(lambda s: marts.demand_features(s.dim_products, s.fct_sales, s.dim_dates))
    # its rows by stretches of days, without the past
    mart_stretches = cached_property(lambda s: marts.demand_stretches(s.dim_products, s.fct_sales, (), ()))
    mart_rejects = _kept("mart_rejects", lambda s: marts.reject_history(s.reject_runs))
    bronze_events = _kept("bronze_events", lambda s: testdata.bronze_events(s.spark, s.dir))
    bronze_export = _kept("bronze_export", lambda s: testdata.bronze_export(s.spark, s.dir))
    clean_events = cached_property(lambda s: cleaning.clean_events(s.bronze_events))
    web_lines = _parts("web-lines", lambda s: cleaning.web_order_lines(s.clean_events[0], s.catalogue))
    market_lines = _parts("marketplace-lines", lambda s: cleaning.marketplace_lines(s.bronze_export, s.catalogue))
    # from messages and exports to gold as one chain
    chain_lines = _kept("chain_lines", lambda s: s.web_lines[0].unionByName(s.market_lines[0]))
    chain_gold_lines = cached_property(lambda s: gold.order_lines(s.chain_lines))
    chain_orders = cached_property(lambda s: gold.orders(s.chain_lines))


#: The engine's tables in DuckDB SQL, over the shared views.
VIEWS: dict[str, str] = {
    "lineitem_rows": "SELECT l_orderkey, l_linenumber FROM lineitem",
    "gold_lines": """
      SELECT order_id, line_number, source, product_id, quantity, unit_price, discount_pct, gross_amount, (gross_amount - net_amount)::DECIMAL(12,2) AS discount_amount, net_amount FROM (
        SELECT *, round(gross_amount * (100 - discount_pct) * 0.01::DECIMAL(3,2), 2)::DECIMAL(12,2) AS net_amount FROM (SELECT *, (quantity * unit_price)::DECIMAL(12,2) AS gross_amount FROM silver_lines))""",
    "gold_orders": """
      SELECT f.order_id, source, channel, customer_id, order_ts, CAST(timezone('Europe/Paris', timezone('UTC', order_ts)) AS DATE) AS order_date, status, status_ts, cancelled_at IS NOT NULL AS is_cancelled, returned_at IS NOT NULL AS is_returned,
        paid_at, shipped_at, delivered_at, cancelled_at, returned_at, payment_method, shipping_city, shipping_postal_code, lines_count, units, gross_amount, discount_amount, net_amount,
        coalesce(shipping_fee, 0)::DECIMAL(10,2) AS shipping_fee, (net_amount + coalesce(shipping_fee, 0))::DECIMAL(12,2) AS total_amount, source_total_amount
      FROM (SELECT order_id, any_value(source) AS source, any_value(channel) AS channel, any_value(customer_id) AS customer_id, min(order_ts) AS order_ts, min(status) AS status, min(status_ts) AS status_ts, min(paid_at) AS paid_at, min(shipped_at) AS shipped_at,
          min(delivered_at) AS delivered_at, min(cancelled_at) AS cancelled_at, min(returned_at) AS returned_at, min(payment_method) AS payment_method, min(shipping_city) AS shipping_city, min(shipping_postal_code) AS shipping_postal_code,
          min(shipping_fee) AS shipping_fee, min(source_total_amount) AS source_total_amount FROM silver_lines GROUP BY order_id) f
      JOIN (SELECT order_id, count(*)::INT AS lines_count, sum(quantity)::INT AS units, sum(gross_amount)::DECIMAL(12,2) AS gross_amount, sum(discount_amount)::DECIMAL(12,2) AS discount_amount, sum(net_amount)::DECIMAL(12,2) AS net_amount FROM gold_lines GROUP BY order_id) a ON f.order_id = a.order_id""",
    "customer_typed": r"""
      SELECT nullif(trim(customer_id), '') AS customer_id, nullif(trim(first_name), '') AS first_name, nullif(trim(last_name), '') AS last_name,
        CASE WHEN regexp_matches(lower(trim(email)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$') THEN lower(trim(email)) END AS email, phone, city,
        CASE WHEN regexp_matches(trim(postal_code), '^[0-9]{5}$') THEN trim(postal_code) END AS postal_code, country, TRY_CAST(created_at AS TIMESTAMP) AS created_at, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at, _ingested_at FROM bronze_customers""",
    "customer_versions": """
      SELECT customer_id, first_name, last_name, email, phone, city, postal_code, country, created_at, updated_at, CASE WHEN nth = 1 THEN least(coalesce(created_at, updated_at), updated_at) ELSE updated_at END AS valid_from, valid_to, valid_to IS NULL AS is_current FROM (
        SELECT *, row_number() OVER w AS nth, lead(updated_at) OVER w AS valid_to FROM (SELECT * FROM customer_typed WHERE customer_id IS NOT NULL AND updated_at IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY customer_id, updated_at ORDER BY _ingested_at DESC) = 1) WINDOW w AS (PARTITION BY customer_id ORDER BY updated_at))""",
    "product_typed": """
      SELECT product_id, name, nullif(trim(category), '') AS category, brand, CASE WHEN TRY_CAST(unit_price AS DECIMAL(10,2)) > 0 THEN TRY_CAST(unit_price AS DECIMAL(10,2)) END AS unit_price, currency, lower(trim(is_active)) = 'true' AS is_active,
        TRY_CAST(created_at AS TIMESTAMP) AS created_at, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at, _ingested_at FROM bronze_products""",
    "product_versions": """
      SELECT product_id, name, category, brand, unit_price, currency, is_active, created_at, updated_at, CASE WHEN nth = 1 THEN least(coalesce(created_at, updated_at), updated_at) ELSE updated_at END AS valid_from, valid_to, valid_to IS NULL AS is_current FROM (
        SELECT *, row_number() OVER w AS nth, lead(updated_at) OVER w AS valid_to FROM (SELECT * FROM product_typed WHERE product_id IS NOT NULL AND updated_at IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY product_id, updated_at ORDER BY _ingested_at DESC) = 1) WINDOW w AS (PARTITION BY product_id ORDER BY updated_at))""",
    "gold_customers": "SELECT customer_id, first_name, last_name, email, phone, city, postal_code, country, created_at AS signup_ts, CAST(timezone('Europe/Paris', timezone('UTC', created_at)) AS DATE) AS signup_date, updated_at FROM customer_versions WHERE is_current",
    "gold_products": "SELECT product_id, name, coalesce(category, 'Unknown') AS category, coalesce(brand, 'Unknown') AS brand, unit_price, currency, is_active, created_at, updated_at FROM product_versions WHERE is_current",
    "dim_dates": """
      SELECT (year(date_day) * 10000 + month(date_day) * 100 + day(date_day))::INT AS date_key, date_day, year(date_day)::INT AS year, quarter(date_day)::INT AS quarter, month(date_day)::INT AS month, strftime(date_day, '%B') AS month_name, strftime(date_day, '%Y-%m') AS year_month,
        isoyear(date_day)::INT AS iso_year, week(date_day)::INT AS iso_week, isodow(date_day)::INT AS day_of_week, dayname(date_day) AS day_name, isodow(date_day) IN (6, 7) AS is_weekend, holiday_date IS NOT NULL AS is_public_holiday, holiday_name, event_name IS NOT NULL AS is_sales_event, event_name AS sales_event
      FROM (SELECT unnest(generate_series(date_trunc('month', min(order_date))::DATE, max(order_date) + 90, INTERVAL 1 DAY))::DATE AS date_day FROM gold_orders) LEFT JOIN holidays ON holiday_date = date_day LEFT JOIN sales_windows ON date_day BETWEEN start_date AND end_date""",
    "dim_channels": """
      SELECT DISTINCT channel, array_to_string(list_transform(string_split(lower(channel), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS channel_name, source, CASE source WHEN 'marketplace' THEN 'Partner marketplace (daily CSV export)' WHEN 'web_shop' THEN 'Own shop (order events)' ELSE source END AS source_system, source = 'web_shop' AS is_own_shop FROM gold_orders""",
    "dim_customers": """
      SELECT md5(customer_id) AS customer_key, customer_id, concat_ws(' ', first_name, last_name) AS full_name, left(postal_code, 2) AS department_code, first_name, last_name, email, city, postal_code, country, signup_date FROM gold_customers
      UNION ALL SELECT md5('_unknown_'), 'UNKNOWN', 'Unknown customer', NULL, NULL, NULL, NULL, 'Unknown', NULL, NULL, NULL""",
    "dim_products": """
      SELECT md5(product_id) AS product_key, product_id, name AS product_name, category, brand, unit_price AS current_unit_price, currency, is_active, created_at::DATE AS created_date, CASE WHEN NOT is_active THEN updated_at::DATE END AS discontinued_date FROM gold_products
      UNION ALL SELECT md5('_unknown_'), 'UNKNOWN', 'Unknown product', 'Unknown', 'Unknown', NULL, NULL, false, NULL, NULL""",
    "fct_sales": """
      SELECT md5(l.order_id || '|' || l.line_number) AS sale_key, l.order_id, l.line_number, (year(o.order_date) * 10000 + month(o.order_date) * 100 + day(o.order_date))::INT AS order_date_key, coalesce(c.customer_key, md5('_unknown_')) AS customer_key,
        coalesce(p.product_key, md5('_unknown_')) AS product_key, o.order_date, o.channel, o.source, o.status AS order_status, o.is_cancelled, o.is_returned, l.quantity, l.unit_price, l.discount_pct, l.gross_amount, l.discount_amount, l.net_amount,
        CASE WHEN o.is_cancelled THEN 0 ELSE l.quantity END AS units_sold, (CASE WHEN o.is_cancelled THEN 0 ELSE l.net_amount END)::DECIMAL(12,2) AS net_sales_amount
      FROM gold_lines l JOIN gold_orders o ON l.order_id = o.order_id LEFT JOIN dim_customers c ON c.customer_id = o.customer_id LEFT JOIN dim_products p ON p.product_id = l.product_id""",
    "fct_orders": """
      SELECT o.order_id, (year(order_date) * 10000 + month(order_date) * 100 + day(order_date))::INT AS order_date_key, coalesce(c.customer_key, md5('_unknown_')) AS customer_key, order_date, order_ts, channel, source, status AS order_status, payment_method, shipping_city, shipping_postal_code,
        left(shipping_postal_code, 2) AS shipping_department_code, is_cancelled, is_returned, paid_at, shipped_at, delivered_at, cancelled_at, returned_at,
        round(date_diff('microsecond', order_ts, shipped_at)::DOUBLE / 3600000000, 1)::DECIMAL(12,1) AS hours_to_ship, round(date_diff('microsecond', order_ts, delivered_at)::DOUBLE / 86400000000, 2)::DECIMAL(12,2) AS days_to_deliver,
        lines_count, units, gross_amount, discount_amount, net_amount, shipping_fee, total_amount, source_total_amount, CASE WHEN is_cancelled THEN 0 ELSE units END AS units_sold,
        (CASE WHEN is_cancelled THEN 0 ELSE net_amount END)::DECIMAL(12,2) AS net_sales_amount, (CASE WHEN is_cancelled THEN 0 ELSE total_amount END)::DECIMAL(12,2) AS billed_amount
      FROM gold_orders o LEFT JOIN dim_customers c ON c.customer_id = o.customer_id""",
    "mart_daily": """
      SELECT d.date_day, d.year, d.year_month, d.iso_week, d.day_name, d.is_weekend, d.is_public_holiday, d.sales_event, s.channel, p.category, count(DISTINCT order_id) FILTER (WHERE NOT is_cancelled) AS orders, sum(units_sold)::BIGINT AS units_sold,
        (sum(gross_amount) FILTER (WHERE NOT is_cancelled))::DECIMAL(18,2) AS gross_sales, (sum(discount_amount) FILTER (WHERE NOT is_cancelled))::DECIMAL(18,2) AS discounts, sum(net_sales_amount)::DECIMAL(18,2) AS net_sales,
        count(DISTINCT order_id) FILTER (WHERE is_cancelled) AS cancelled_orders, coalesce(sum(net_amount) FILTER (WHERE is_cancelled), 0)::DECIMAL(18,2) AS cancelled_amount, count(DISTINCT order_id) FILTER (WHERE is_returned) AS returned_orders,
        coalesce(sum(net_amount) FILTER (WHERE is_returned), 0)::DECIMAL(18,2) AS returned_amount
      FROM fct_sales s JOIN dim_dates d ON d.date_key = s.order_date_key JOIN dim_products p ON p.product_key = s.product_key GROUP BY ALL""",
    "mart_customers": """
      SELECT c.customer_key, c.customer_id, c.full_name, c.city, c.department_code, c.signup_date, coalesce(h.orders_placed, 0) AS orders_placed, coalesce(h.orders, 0) AS orders, coalesce(h.cancelled_orders, 0) AS cancelled_orders, coalesce(h.returned_orders, 0) AS returned_orders,
        h.first_order_date, h.last_order_date, coalesce(h.units_bought, 0)::BIGINT AS units_bought, coalesce(h.total_spent, 0)::DECIMAL(18,2) AS total_spent, (CASE WHEN h.orders > 0 THEN (((h.total_spent * 100)::HUGEINT * 2 + h.orders) // (2 * h.orders))::DECIMAL(18,0) * 0.01 END)::DECIMAL(18,2) AS average_order_value,
        ((SELECT max(order_date) FROM fct_orders) - h.last_order_date)::INT AS days_since_last_order, CASE WHEN coalesce(h.orders, 0) = 0 THEN 'No purchase' WHEN h.orders = 1 THEN 'One-time' WHEN h.orders <= 4 THEN 'Repeat' ELSE 'Loyal' END AS customer_segment
      FROM dim_customers c LEFT JOIN (SELECT customer_key, count(*) AS orders_placed, count(*) FILTER (WHERE NOT is_cancelled) AS orders, count(*) FILTER (WHERE is_cancelled) AS cancelled_orders, count(*) FILTER (WHERE is_returned) AS returned_orders,
          min(order_date) FILTER (WHERE NOT is_cancelled) AS first_order_date, max(order_date) FILTER (WHERE NOT is_cancelled) AS last_order_date, sum(units_sold) AS units_bought, sum(billed_amount) AS total_spent FROM fct_orders GROUP BY customer_key) h ON h.customer_key = c.customer_key
      WHERE c.customer_id <> 'UNKNOWN'""",
    "demand_grid": """
      SELECT p.product_key, p.product_id, p.category, p.brand, unnest(generate_series(greatest(p.created_date, a), least(coalesce(p.discontinued_date, z), z), INTERVAL 1 DAY))::DATE AS date_day
      FROM dim_products p, (SELECT min(order_date) AS a, max(order_date) - 1 AS z FROM fct_sales) WHERE p.product_id <> 'UNKNOWN'""",
    "demand_sold": """
      SELECT product_key, order_date, sum(units_sold)::BIGINT AS units_sold, count(DISTINCT order_id) FILTER (WHERE NOT is_cancelled) AS orders, sum(net_sales_amount)::DECIMAL(18,2) AS net_sales, (CASE WHEN count_if(NOT is_cancelled) > 0 THEN (((sum(unit_price) FILTER (WHERE NOT is_cancelled)) * 100)::HUGEINT * 2 + count_if(NOT is_cancelled)) // (2 * count_if(NOT is_cancelled)) END)::DECIMAL(18,0) * 0.01::DECIMAL(3,2) AS average_unit_price,
        round((sum(discount_amount) FILTER (WHERE NOT is_cancelled))::DOUBLE / nullif((sum(gross_amount) FILTER (WHERE NOT is_cancelled))::DOUBLE, 0), 4) AS discount_rate FROM fct_sales GROUP BY ALL""",
    "mart_rejects": """
      SELECT run_id, checked_at, checked_at::DATE AS checked_date, checked_at = (SELECT max(checked_at) FROM reject_runs) AS is_latest_run, source, reason, rejected,
        rejected - lag(rejected) OVER (PARTITION BY source, reason ORDER BY checked_at) AS change_since_previous_run FROM reject_runs""",
    # what cleaning must make of the events and the export, from the facts behind them
    "event_judged": """
      SELECT *, CASE WHEN truncated THEN 'malformed_json' WHEN nameless OR undated THEN 'missing_field' WHEN kind = 'order_viewed' THEN 'unknown_event_type'
        WHEN kind = 'order_created' AND empty THEN 'missing_field' WHEN kind = 'order_status_changed' AND (status IS NULL OR status = 'lost') THEN 'unknown_status' END AS reason FROM event_facts""",
    "event_good": "SELECT 'E' || event_id AS event_id, order_id, event_ts, kind, CASE WHEN NOT creates THEN status END AS status, customer_id, price, quantity, percent, product_id FROM event_judged WHERE reason IS NULL",
    "event_created": "SELECT * FROM event_good WHERE kind = 'order_created' QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_ts, event_id) = 1",
    "event_states": """
      SELECT order_id, max(struct_pack(t := event_ts, s := status)).s AS status, max(event_ts) AS status_ts, min(event_ts) FILTER (WHERE status = 'paid') AS paid_at, min(event_ts) FILTER (WHERE status = 'shipped') AS shipped_at,
        min(event_ts) FILTER (WHERE status = 'delivered') AS delivered_at, min(event_ts) FILTER (WHERE status = 'cancelled') AS cancelled_at, min(event_ts) FILTER (WHERE status = 'returned') AS returned_at
      FROM event_good WHERE kind = 'order_status_changed' GROUP BY order_id""",
    "web_judged": """
      SELECT c.order_id, 1 AS line_number, 'web_shop' AS source, 'web' AS channel, c.customer_id, c.event_ts AS order_ts, coalesce(s.status, 'created') AS status, coalesce(s.status_ts, c.event_ts) AS status_ts, paid_at, shipped_at, delivered_at, cancelled_at, returned_at,
        'card' AS payment_method, 'Nice' AS shipping_city, '06000' AS shipping_postal_code, 4.90::DECIMAL(10,2) AS shipping_fee, c.price::DECIMAL(12,2) AS source_total_amount, c.product_id, c.quantity, c.price AS unit_price, c.percent AS discount_pct,
        CASE WHEN c.quantity <= 0 THEN 'invalid_quantity' WHEN k.product_id IS NULL THEN 'unknown_product' WHEN c.price < 0 OR c.percent NOT BETWEEN 0 AND 100 THEN 'invalid_amount' END AS reason
      FROM event_created c LEFT JOIN event_states s ON s.order_id = c.order_id LEFT JOIN catalogue k ON k.product_id = c.product_id""",
    "export_typed": """
      SELECT DISTINCT order_id, CASE WHEN NOT undated THEN timezone('UTC', timezone('Europe/Paris', ordered_local)) END AS order_ts, timezone('UTC', timezone('Europe/Paris', updated_local)) AS updated_ts,
        CASE lower(trim(label)) WHEN 'retournée' THEN 'returned' WHEN 'livrée' THEN 'delivered' WHEN 'expédiée' THEN 'shipped' WHEN 'payée' THEN 'paid' END AS status, nullif(customer, '') AS customer_id, line_number,
        product_ref AS product_id, CASE WHEN NOT wordy THEN quantity END AS quantity, price AS unit_price, percent AS discount_pct, fee AS shipping_fee, 'card' AS payment_method, 'Nice' AS shipping_city, '06000' AS shipping_postal_code, file_date, torn FROM export_facts""",
    "export_judged": """
      SELECT t.*, CASE WHEN torn THEN 'malformed_row' WHEN order_ts IS NULL THEN 'invalid_format' WHEN status IS NULL THEN 'unknown_status' WHEN quantity IS NULL OR quantity <= 0 THEN 'invalid_quantity' WHEN k.product_id IS NULL THEN 'unknown_product'
        WHEN unit_price < 0 OR discount_pct NOT BETWEEN 0 AND 100 THEN 'invalid_amount' END AS reason, NOT torn AND order_ts IS NOT NULL AND status IS NOT NULL AS tells_order FROM export_typed t LEFT JOIN catalogue k ON k.product_id = t.product_id""",
    "export_orders": """
      SELECT order_id, max(struct_pack(u := updated_ts, f := file_date, o := order_ts, s := status, p := payment_method, c := shipping_city, z := shipping_postal_code, e := shipping_fee)) AS z, max(customer_id) AS customer_id, min(updated_ts) FILTER (WHERE status = 'paid') AS paid_at,
        min(updated_ts) FILTER (WHERE status = 'shipped') AS shipped_at, min(updated_ts) FILTER (WHERE status = 'delivered') AS delivered_at, min(updated_ts) FILTER (WHERE status = 'cancelled') AS cancelled_at, min(updated_ts) FILTER (WHERE status = 'returned') AS returned_at
      FROM export_judged WHERE tells_order GROUP BY order_id""",
    "export_lines": "SELECT order_id, line_number, max(struct_pack(u := updated_ts, f := file_date, p := product_id, q := quantity, a := unit_price, d := discount_pct)) AS z FROM export_judged WHERE reason IS NULL GROUP BY order_id, line_number",
    "all_rejects": """
      SELECT 'order_events' AS source, reason, CASE WHEN twice THEN 2 ELSE 1 END AS n FROM event_judged WHERE reason IS NOT NULL
      UNION ALL SELECT 'order_events', 'orphan_status_event', 1 FROM event_good WHERE kind = 'order_status_changed' AND order_id NOT IN (SELECT order_id FROM event_created)
      UNION ALL SELECT 'order_events', reason, 1 FROM web_judged WHERE reason IS NOT NULL
      UNION ALL SELECT 'marketplace_orders', reason, 1 FROM export_judged WHERE reason IS NOT NULL
      UNION ALL SELECT 'customers', CASE WHEN customer_id IS NULL THEN 'missing_key' ELSE 'invalid_timestamp' END, 1 FROM customer_typed WHERE customer_id IS NULL OR updated_at IS NULL
      UNION ALL SELECT 'products', 'invalid_timestamp', 1 FROM product_typed WHERE updated_at IS NULL""",
}
VIEWS["chain_lines"] = """
      SELECT order_id, line_number, source, channel, customer_id, order_ts, status, status_ts, paid_at, shipped_at, delivered_at, cancelled_at, returned_at, payment_method, shipping_city, shipping_postal_code, shipping_fee, source_total_amount, product_id, quantity, unit_price, discount_pct FROM web_judged WHERE reason IS NULL
      UNION ALL SELECT l.order_id, l.line_number, 'marketplace', 'marketplace', o.customer_id, o.z.o, o.z.s, o.z.u, paid_at, shipped_at, delivered_at, cancelled_at, returned_at, o.z.p, o.z.c, o.z.z, o.z.e, NULL::DECIMAL(12,2), l.z.p, l.z.q, l.z.a, l.z.d FROM export_lines l JOIN export_orders o ON o.order_id = l.order_id"""
VIEWS["chain_gold_lines"] = VIEWS["gold_lines"].replace("silver_lines", "chain_lines")
VIEWS["chain_orders"] = VIEWS["gold_orders"].replace("silver_lines", "chain_lines").replace("gold_lines", "chain_gold_lines")


def duck(sql: str) -> str:
    """A text over the engine's tables as one DuckDB statement over the driver's."""
    views = {n: t.replace("TIMESTAMP_NTZ", "TIMESTAMP") for n, t in (testdata.SHARED | VIEWS).items()}
    return testdata.compose(sql, views)


def query(name: str, oracle: str | None = None):
    """Registers a function of a Shop under a name, with the text of its oracle."""

    def register(f: Callable[[Shop], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Shop.of(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = duck(oracle)
        return f

    return register


def both(name: str, sql: str, *frames: str) -> None:
    """Registers one text that both engines run: on Spark over the engine's tables, named in braces."""
    plain = sql
    for f in frames:
        plain = plain.replace("{" + f + "}", f)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        shop = Shop.of(spark, sf_dir)
        return spark.sql(sql, **{f: getattr(shop, f) for f in frames})

    QUERIES[name] = run
    ORACLES[name] = duck(plain)
