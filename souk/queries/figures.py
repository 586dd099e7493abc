"""Check figures, dashboard cubes and interactive figures. Texts that both engines run alike; frames where they don't."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from souk.operators import series
from souk.operators.joins import with_scalar
from souk.operators.rows import top_per_group
from souk.plans import cubes, measures
from souk.queries.base import both, query


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(18,2))"


def count(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def share(part: str, whole: str, digits: int = 6) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), {digits})"


def plain(sql: str) -> str:
    """A text of both engines as an oracle of frames."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


NET, UNITS = money("sum(net_sales_amount)"), count("sum(units_sold)")
ORDERS = "count(DISTINCT CASE WHEN NOT is_cancelled THEN order_id END)"
GROSS, DISC = (money(f"sum({c}) FILTER (WHERE NOT is_cancelled)") for c in ("gross_amount", "discount_amount"))

both("fig_sales_cards", f"SELECT {NET} AS net_sales, {UNITS} AS units_sold, {ORDERS} AS orders, {share('sum(net_sales_amount)', ORDERS, 2)} AS average_basket, {GROSS} AS gross_sales, {DISC} AS discounts, {share(f'100 * {DISC}', GROSS, 2)} AS discount_rate FROM {{fct_sales}}", "fct_sales")
both(
    "fig_monthly",
    f"""SELECT year_month, net_sales, lag(net_sales) OVER (ORDER BY year_month) AS previous_month, {share('100 * (net_sales - lag(net_sales) OVER (ORDER BY year_month))', 'lag(net_sales) OVER (ORDER BY year_month)', 1)} AS change
    FROM (SELECT year_month, {NET} AS net_sales FROM {{fct_sales}} s JOIN {{dim_dates}} d ON d.date_key = s.order_date_key GROUP BY year_month) t""",
    "fct_sales", "dim_dates",
)
_SMOOTH = f"SELECT order_date, net_sales, round(avg(CAST(net_sales AS DOUBLE)) OVER (ORDER BY order_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 2) AS average_7d FROM (SELECT order_date, {NET} AS net_sales FROM {{fct_sales}} GROUP BY order_date) t"
both("avg7_rows", _SMOOTH, "fct_sales")
both("fig_avg7", f"SELECT * FROM ({_SMOOTH}) u ORDER BY order_date DESC LIMIT 10", "fct_sales")
both("fig_channel", f"SELECT channel_name, {NET} AS net_sales, {ORDERS} AS orders, {UNITS} AS units_sold FROM {{fct_sales}} s JOIN {{dim_channels}} c ON c.channel = s.channel GROUP BY channel_name", "fct_sales", "dim_channels")
both("by_channel", f"SELECT channel, {NET} AS net_sales FROM {{fct_sales}} GROUP BY channel ORDER BY net_sales DESC, channel", "fct_sales")
both("fig_category", f"SELECT category, {NET} AS net_sales, {UNITS} AS units_sold, {share(f'100 * {DISC}', GROSS, 2)} AS discount_rate FROM {{fct_sales}} s JOIN {{dim_products}} p ON p.product_key = s.product_key GROUP BY category", "fct_sales", "dim_products")
_TOP = f"SELECT product_id, category, {NET} AS net_sales, {UNITS} AS units_sold FROM {{fct_sales}} s JOIN {{dim_products}} p ON p.product_key = s.product_key"
for _key in ("fig_top_products", "top_products"):
    both(_key, f"{_TOP} GROUP BY product_id, category ORDER BY net_sales DESC, product_id LIMIT 10", "fct_sales", "dim_products")
both("top_products_filtered", f"{_TOP} WHERE channel = '1-URGENT' AND order_date >= DATE '1997-01-01' AND category <> 'Unknown' GROUP BY product_id, category ORDER BY net_sales DESC, product_id LIMIT 20", "fct_sales", "dim_products")
_BUY, _REP = "count(*) FILTER (WHERE orders > 0)", "count(*) FILTER (WHERE orders >= 2)"
both("fig_customer_cards", f"SELECT count(*) AS customers, {_BUY} AS buyers, {_REP} AS repeat_buyers, {share(f'100 * {_REP}', _BUY, 1)} AS repeat_rate, {money('sum(total_spent)')} AS lifetime_spend, {share('sum(total_spent)', _BUY, 2)} AS average_spend FROM {{mart_customers}}", "mart_customers")
both("fig_segment", f"SELECT customer_segment, count(*) AS customers, {money('sum(total_spent)')} AS lifetime_spend FROM {{mart_customers}} GROUP BY customer_segment", "mart_customers")
both("fig_department", f"SELECT department_code, {NET} AS net_sales FROM {{fct_sales}} s JOIN {{dim_customers}} c ON c.customer_key = s.customer_key GROUP BY department_code ORDER BY net_sales DESC, department_code LIMIT 10", "fct_sales", "dim_customers")
_CAN, _RET, _KEPT = (f"count(*) FILTER (WHERE {x})" for x in ("is_cancelled", "is_returned", "NOT is_cancelled"))
_OPS = f"count(*) AS orders_placed, {share(f'100 * {_CAN}', 'count(*)', 2)} AS cancellation_rate, {share(f'100 * {_RET}', _KEPT, 2)} AS return_rate, round(avg(CAST(hours_to_ship AS DOUBLE)), 1) AS average_hours_to_ship, round(avg(CAST(days_to_deliver AS DOUBLE)), 2) AS average_days_to_deliver"
_SHIP = money("sum(shipping_fee) FILTER (WHERE NOT is_cancelled)")
both("fig_order_cards", f"SELECT {_OPS}, {_CAN} AS cancelled_orders, {_RET} AS returned_orders, {money('sum(billed_amount)')} AS billed_amount, {_SHIP} AS shipping_fees, {share('sum(billed_amount)', _KEPT, 2)} AS average_order_value FROM {{fct_orders}}", "fct_orders")
both("fig_status", "SELECT order_status, count(*) AS orders_placed FROM {fct_orders} GROUP BY order_status", "fct_orders")
both("fig_ops_channel", f"SELECT channel_name, {_OPS} FROM {{fct_orders}} o JOIN {{dim_channels}} c ON c.channel = o.channel GROUP BY channel_name", "fct_orders", "dim_channels")
both("fig_payment", f"SELECT payment_method, count(*) AS orders_placed, {money('sum(billed_amount)')} AS billed_amount FROM {{fct_orders}} GROUP BY payment_method", "fct_orders")
both("fig_rejects", "SELECT source, reason, rejected, change_since_previous_run FROM {mart_rejects} WHERE is_latest_run ORDER BY rejected DESC, source, reason", "mart_rejects")

# cubes, with small indexes in place of names
_BOUNDS = "(SELECT min(order_date) AS first_day, max(order_date) AS last_day FROM {fct_sales}) b"
_INDEX_CHANNEL = "(SELECT channel, channel_name, CAST(row_number() OVER (ORDER BY net DESC, channel_name) - 1 AS INT) AS i FROM (SELECT c.channel, c.channel_name, coalesce(sum(net_sales_amount), 0) AS net FROM {dim_channels} c LEFT JOIN {fct_sales} f ON f.channel = c.channel GROUP BY c.channel, c.channel_name) t)"
_INDEX_CATEGORY = "(SELECT category, CAST(row_number() OVER (ORDER BY net DESC, category) - 1 AS INT) AS i FROM (SELECT p.category, coalesce(sum(net_sales_amount), 0) AS net FROM {dim_products} p LEFT JOIN {fct_sales} f ON f.product_key = p.product_key GROUP BY p.category) t)"
_INDEX_STATUS = "(SELECT order_status, CAST(row_number() OVER (ORDER BY CASE order_status WHEN 'created' THEN 1 WHEN 'paid' THEN 2 WHEN 'shipped' THEN 3 WHEN 'delivered' THEN 4 WHEN 'returned' THEN 5 WHEN 'cancelled' THEN 6 ELSE 7 END, order_status) - 1 AS INT) AS i FROM (SELECT DISTINCT order_status FROM {fct_orders}) t)"
_INDEX_PAYMENT = "(SELECT payment_method, CAST(row_number() OVER (ORDER BY n DESC, payment_method NULLS LAST) - 1 AS INT) AS i FROM (SELECT payment_method, count(*) AS n FROM {fct_orders} GROUP BY payment_method) t)"
_DAY = "CAST(order_date AS STRING)"
query("dim_index", plain(f"SELECT 'channel' AS kind, channel_name AS name, i FROM {_INDEX_CHANNEL} a UNION ALL SELECT 'category', category, i FROM {_INDEX_CATEGORY} b"))(lambda s: cubes.channel_index(s.dim_channels, s.fct_sales).select(F.lit("channel").alias("kind"), F.col("channel_name").alias("name"), "i").unionAll(cubes.category_index(s.dim_products, s.fct_sales).select(F.lit("category"), "category", "i")))
query("status_index", plain(f"SELECT order_status, i FROM {_INDEX_STATUS} a"))(lambda s: cubes.status_index(s.fct_orders))
query("cube_sales", plain(f"SELECT order_date, ch.i AS channel_i, k.i AS category_i, {NET} AS net, {UNITS} AS units, coalesce({GROSS}, 0) AS gross, coalesce({DISC}, 0) AS discounts, {ORDERS} AS orders FROM {{fct_sales}} s JOIN {_INDEX_CHANNEL} ch ON ch.channel = s.channel JOIN {{dim_products}} p ON p.product_key = s.product_key JOIN {_INDEX_CATEGORY} k ON k.category = p.category GROUP BY order_date, ch.i, k.i"))(lambda s: cubes.sales(s.fct_sales, s.dim_channels, s.dim_products))
query("cube_sales_orders", plain(f"SELECT order_date, ch.i AS channel_i, {ORDERS} AS orders FROM {{fct_sales}} s JOIN {_INDEX_CHANNEL} ch ON ch.channel = s.channel GROUP BY order_date, ch.i"))(lambda s: cubes.sales_orders(s.fct_sales, s.dim_channels))
query("cube_product_sales", plain(f"SELECT order_date, ch.i AS channel_i, product_id, {NET} AS net, {UNITS} AS units FROM {{fct_sales}} s JOIN {_INDEX_CHANNEL} ch ON ch.channel = s.channel JOIN {{dim_products}} p ON p.product_key = s.product_key GROUP BY order_date, ch.i, product_id HAVING sum(units_sold) > 0"))(lambda s: cubes.product_sales(s.fct_sales, s.dim_channels, s.dim_products))
both("having", f"SELECT product_key, {UNITS} AS units FROM {{fct_sales}} GROUP BY product_key HAVING sum(units_sold) > 500", "fct_sales")
query("cube_orders", plain(
    f"""SELECT order_date, ch.i AS channel_i, st.i AS status_i, pm.i AS payment_i, count(*) AS n, {_CAN} AS cancelled, {_RET} AS returned, {money('sum(billed_amount)')} AS billed, coalesce({_SHIP}, 0) AS shipping, {money('coalesce(sum(hours_to_ship), 0)')} AS hours_sum, count(hours_to_ship) AS hours_n,
    {money('coalesce(sum(days_to_deliver), 0)')} AS days_sum, count(days_to_deliver) AS days_n FROM {{fct_orders}} o JOIN {_INDEX_CHANNEL} ch ON ch.channel = o.channel JOIN {_INDEX_STATUS} st ON st.order_status = o.order_status JOIN {_INDEX_PAYMENT} pm ON pm.payment_method = o.payment_method GROUP BY order_date, ch.i, st.i, pm.i"""
))(lambda s: cubes.orders(s.fct_orders, s.fct_sales, s.dim_channels))
query("event_days", plain(f"SELECT date_day, sales_event, holiday_name FROM {{dim_dates}} CROSS JOIN {_BOUNDS} WHERE date_day BETWEEN first_day AND last_day AND (is_sales_event OR is_public_holiday)"))(lambda s: cubes.event_days(s.dim_dates, s.fct_sales))
_ALL = "CASE WHEN grouping(customer_segment) = 1 THEN 'All' ELSE customer_segment END"
query("segments", plain(f"SELECT {_ALL} AS segment, count(*) AS customers, {_BUY} AS buyers, {_REP} AS repeat_buyers, {money('sum(total_spent)')} AS lifetime_spend FROM {{mart_customers}} GROUP BY GROUPING SETS ((), (customer_segment))"))(lambda s: cubes.segments(s.mart_customers))
_DEPT = f"SELECT {_ALL} AS segment, c.department_code, {NET} AS net FROM {{fct_sales}} f JOIN {{dim_customers}} c ON c.customer_key = f.customer_key LEFT JOIN {{mart_customers}} m ON m.customer_key = f.customer_key WHERE c.department_code IS NOT NULL GROUP BY GROUPING SETS ((c.department_code), (c.department_code, customer_segment))"
query("dept_by_segment", plain(_DEPT))(lambda s: cubes.departments(s.fct_sales, s.dim_customers, s.mart_customers))
query("top_departments", plain(f"SELECT segment, department_code, net, place FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY net DESC, department_code) AS place FROM ({_DEPT}) t) u WHERE place <= 10"))(lambda s: cubes.top_departments(s.fct_sales, s.dim_customers, s.mart_customers))


@query("recency_hist", "SELECT CASE WHEN grouping(customer_segment) = 1 THEN 'All' ELSE customer_segment END AS segment, (d * 30)::INT AS days_from, count(*) AS customers FROM (SELECT customer_segment, days_since_last_order // 30 AS d FROM mart_customers WHERE days_since_last_order IS NOT NULL) GROUP BY GROUPING SETS ((d), (d, customer_segment))")
def _(s):
    """Buckets of 30 days; each customer counts in its segment and in All."""
    m = s.mart_customers.where("days_since_last_order is not null")
    bucket = (F.expr("days_since_last_order div 30") * 30).cast("int")
    return m.select(F.explode(F.array(F.lit("All"), "customer_segment")).alias("segment"), bucket.alias("days_from")).groupBy("segment", "days_from").agg(F.count(F.lit(1)).alias("customers"))


def _ranked(s):
    return s.mart_customers.withColumn("segment", F.explode(F.array(F.lit("All"), "customer_segment")))


@query("customer_rank", "SELECT 'All' AS segment, customer_id FROM mart_customers UNION ALL SELECT customer_segment, customer_id FROM mart_customers")
def _(s):
    return _ranked(s).select("segment", "customer_id")


@query("top_customers", "SELECT segment, customer_id, total_spent, row_number() OVER (PARTITION BY segment ORDER BY total_spent DESC, customer_id) AS place FROM (SELECT 'All' AS segment, * FROM mart_customers UNION ALL SELECT customer_segment, * FROM mart_customers) WHERE total_spent > 0 QUALIFY place <= 20")
def _(s):
    return top_per_group(_ranked(s).where("total_spent > 0"), ["segment"], [F.col("total_spent").desc(), F.col("customer_id")], 20, "place").select("segment", "customer_id", "total_spent", "place")


_MEASURED = [n for n, m in measures.MEASURES.items() if m.table in ("sales", "orders", "customers")]


@query(
    "measures",
    f"""SELECT * FROM (SELECT sum(net_sales_amount)::DECIMAL(18,2) AS net_sales, sum(units_sold)::BIGINT AS units_sold, sum(gross_amount) FILTER (WHERE NOT is_cancelled)::DECIMAL(18,2) AS gross_sales, sum(discount_amount) FILTER (WHERE NOT is_cancelled)::DECIMAL(18,2) AS discounts,
      round((sum(discount_amount) FILTER (WHERE NOT is_cancelled))::DOUBLE / (sum(gross_amount) FILTER (WHERE NOT is_cancelled))::DOUBLE, 6) AS discount_rate, {ORDERS} AS orders, round(sum(net_sales_amount)::DOUBLE / {ORDERS}, 6) AS average_basket FROM fct_sales),
    (SELECT count(*) AS orders_placed, {_CAN} AS cancelled_orders, round({_CAN}::DOUBLE / count(*), 6) AS cancellation_rate, {_RET} AS returned_orders, round({_RET}::DOUBLE / {_KEPT}, 6) AS return_rate, sum(billed_amount)::DECIMAL(18,2) AS billed_amount, sum(shipping_fee) FILTER (WHERE NOT is_cancelled)::DECIMAL(18,2) AS shipping_fees,
      round(sum(billed_amount)::DOUBLE / {_KEPT}, 6) AS average_order_value, round(avg(hours_to_ship::DOUBLE), 6) AS average_hours_to_ship, round(avg(days_to_deliver::DOUBLE), 6) AS average_days_to_deliver FROM fct_orders),
    (SELECT count(*) AS customers, {_BUY} AS buyers, {_REP} AS repeat_buyers, round({_REP}::DOUBLE / {_BUY}, 6) AS repeat_rate, sum(total_spent)::DECIMAL(18,2) AS lifetime_spend, round(sum(total_spent)::DOUBLE / {_BUY}, 6) AS average_spend_per_buyer FROM mart_customers)""",
)
def _(s):
    found = measures.evaluate(_MEASURED, {"sales": s.fct_sales, "orders": s.fct_orders, "customers": s.mart_customers})
    kinds = dict(found.dtypes)
    shown = {n: F.round(n, 6) if kinds[n] == "double" else F.col(n).cast("decimal(18,2)") if kinds[n].startswith("decimal") else F.col(n).cast("long") for n in _MEASURED}
    return found.select(*[x.alias(n) for n, x in shown.items()])


@query("mom", "SELECT year_month, net_sales, lag(net_sales) OVER (ORDER BY year_month) AS previous_month, round((net_sales - lag(net_sales) OVER (ORDER BY year_month))::DOUBLE / lag(net_sales) OVER (ORDER BY year_month)::DOUBLE, 6) AS change FROM (SELECT strftime(order_date, '%Y-%m') AS year_month, sum(net_sales_amount)::DECIMAL(18,2) AS net_sales FROM fct_sales GROUP BY 1)")
def _(s):
    return measures.month_over_month(s.fct_sales, s.dim_dates)


_DAILY = f"SELECT order_date, {NET} AS net_sales FROM fct_sales GROUP BY order_date"


@query("avg7_calendar", f"SELECT order_date, net_sales, round(avg(net_sales::DOUBLE) OVER (ORDER BY order_date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 4) AS average_7d FROM ({_DAILY})")
def _(s):
    daily = s.fct_sales.groupBy("order_date").agg(F.sum("net_sales_amount").cast("decimal(18,2)").alias("net_sales"))
    return series.trailing_average(daily, "order_date", "net_sales", 7, "average_7d").withColumn("average_7d", F.round("average_7d", 4))


# interactive figures: a range of days, the one before, series, buckets
_FROM, _TO = "1997-03-01", "1997-05-31"
_IN = f"order_date BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"
_TOTALS = f"{NET} AS net_sales, {UNITS} AS units_sold, {ORDERS} AS orders, {share('sum(net_sales_amount)', ORDERS, 2)} AS average_basket"
both("kpi_range", f"SELECT {_TOTALS} FROM {{fct_sales}} WHERE {_IN}", "fct_sales")
both(
    "kpi_vs_previous",
    f"""SELECT net_sales, previous, change, CASE WHEN abs(change) < 0.0005 THEN 'flat' WHEN change > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT net_sales, previous, {share('net_sales - previous', 'previous')} AS change FROM (
      SELECT {money(f'sum(CASE WHEN {_IN} THEN net_sales_amount END)')} AS net_sales, {money("sum(CASE WHEN order_date BETWEEN DATE '1996-11-29' AND DATE '1997-02-28' THEN net_sales_amount END)")} AS previous FROM {{fct_sales}}) t) u""",
    "fct_sales",
)
both("daily_series", f"SELECT order_date, {NET} AS net_sales, {UNITS} AS units_sold FROM {{fct_sales}} WHERE {_IN} AND channel = '3-MEDIUM' GROUP BY order_date", "fct_sales")
both("best_day", f"SELECT order_date, {NET} AS net_sales FROM {{fct_sales}} WHERE {_IN} GROUP BY order_date ORDER BY net_sales DESC, order_date LIMIT 1", "fct_sales")
both("channel_mix", f"SELECT channel, net_sales, {share('net_sales', 'sum(net_sales) OVER ()')} AS mix FROM (SELECT channel, {NET} AS net_sales FROM {{fct_sales}} WHERE {_IN} GROUP BY channel) t", "fct_sales")
both("channel_matrix", f"SELECT CASE WHEN grouping(channel) = 1 THEN 'Total' ELSE channel END AS channel, {_OPS} FROM {{fct_orders}} GROUP BY GROUPING SETS ((channel), ())", "fct_orders")


@query("spark_buckets", f"SELECT CAST(datediff('day', DATE '1997-01-01', order_date) // 7 AS INT) AS bucket, {NET} AS net_sales FROM fct_sales WHERE order_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-29' AND datediff('day', DATE '1997-01-01', order_date) // 7 < 25 GROUP BY 1")
def _(s):
    """Weeks from the first day of the range; the last, partial one is left out."""
    inside = s.fct_sales.where("order_date between date'1997-01-01' and date'1997-06-29'")
    return inside.groupBy(F.expr("cast(datediff(order_date, date'1997-01-01') div 7 as int)").alias("bucket")).agg(F.sum("net_sales_amount").cast("decimal(18,2)").alias("net_sales")).where("bucket < 25")


@query("event_bands", "SELECT sales_event, min(date_day) AS first_day, max(date_day) AS last_day, count(*) AS n_days FROM (SELECT sales_event, date_day, date_day - row_number() OVER (PARTITION BY sales_event ORDER BY date_day)::INT AS run FROM dim_dates WHERE is_sales_event) GROUP BY sales_event, run")
def _(s):
    return series.islands(s.dim_dates.where("is_sales_event"), ["sales_event"], "date_day")


@query("monthly_partial", "SELECT strftime(order_date, '%Y-%m') AS year_month, sum(net_sales_amount)::DECIMAL(18,2) AS net_sales, count(DISTINCT order_date) AS days, count(DISTINCT order_date) < day(last_day(min(order_date))) AS is_partial FROM fct_sales GROUP BY 1")
def _(s):
    daily = s.fct_sales.groupBy("order_date").agg(F.sum("net_sales_amount").alias("n"))
    month = daily.groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month")).agg(F.sum("n").cast("decimal(18,2)").alias("net_sales"), F.count(F.lit(1)).alias("days"), F.dayofmonth(F.last_day(F.min("order_date"))).alias("length"))
    return month.withColumn("is_partial", F.col("days") < F.col("length")).drop("length")


@query("range_join", "SELECT d.date_day, w.event_name FROM dim_dates d LEFT JOIN sales_windows w ON d.date_day BETWEEN w.start_date AND w.end_date")
def _(s):
    return series.covering(s.dim_dates.select("date_day"), "date_day", s.sales_windows, "start_date", "end_date", ["event_name"])


@query("scalar_cross", "SELECT customer_id, CAST((SELECT max(last_order_date) FROM mart_customers) - last_order_date AS INT) AS days FROM mart_customers WHERE last_order_date IS NOT NULL")
def _(s):
    m = s.mart_customers
    return with_scalar(m.where("last_order_date is not null"), m.agg(F.max("last_order_date").alias("as_of"))).select("customer_id", F.datediff("as_of", "last_order_date").alias("days"))


both("filters", f"SELECT order_status, {_DAY} AS order_day, count(*) AS n FROM {{fct_orders}} WHERE payment_method IS NOT NULL AND order_status IN ('paid', 'shipped') AND NOT is_cancelled AND units BETWEEN 2 AND 200 AND order_date >= DATE '1996-01-01' GROUP BY order_status, order_date", "fct_orders")
both("filtered_agg", f"SELECT channel, {_CAN} AS cancelled, min(order_date) FILTER (WHERE NOT is_cancelled) AS first_day, max(order_date) FILTER (WHERE is_returned) AS last_return, {money('sum(billed_amount) FILTER (WHERE is_returned)')} AS returned_amount FROM {{fct_orders}} GROUP BY channel", "fct_orders")
both("daily_sales", f"SELECT order_date, channel, {ORDERS} AS orders, count(DISTINCT CASE WHEN is_returned THEN order_id END) AS returned_orders FROM {{fct_sales}} GROUP BY order_date, channel", "fct_sales")
both("orders_by_source", f"SELECT source, count(*) AS orders, min(order_date) AS first_day, max(order_date) AS last_day, {money('sum(total_amount)')} AS total FROM {{gold_orders}} GROUP BY source", "gold_orders")
both("distinct", "SELECT DISTINCT channel, payment_method FROM {shop_orders}", "shop_orders")


@query("anti_join", "SELECT order_id FROM shop_orders WHERE order_no NOT IN (SELECT l_orderkey FROM lineitem)")
def _(s):
    return s.shop_orders.join(s.table("lineitem").select(F.col("l_orderkey").alias("order_no")), "order_no", "left_anti").select("order_id")
