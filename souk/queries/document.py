"""The dashboard's document as a query, one row for each item of a section."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.operators.rows import numbered
from souk.plans import cubes, dashboard
from souk.queries.base import VIEWS, Shop, _kept, query
from souk.queries.figures import _ALL, _BOUNDS, _BUY, _CAN, _DEPT, _INDEX_CATEGORY, _INDEX_CHANNEL, _INDEX_PAYMENT, _INDEX_STATUS, _KEPT, _REP, _RET, _SHIP, DISC, GROSS, NET, ORDERS, UNITS, money

VIEWS["product_index"] = "SELECT product_key, product_name, category, (row_number() OVER (ORDER BY product_name, product_key) - 1)::BIGINT AS i FROM dim_products"
Shop.product_index = _kept("product_index", lambda s: numbered(s.dim_products.select("product_key", "product_name", "category"), ["product_name", "product_key"], "i"))
Shop.product_index.__set_name__(Shop, "product_index")

_D = "CAST(order_date - first_day AS INT)"
_CH = f"JOIN {_INDEX_CHANNEL} ch ON ch.channel = f.channel"
_CAT = f"JOIN {{dim_products}} p ON p.product_key = f.product_key JOIN {_INDEX_CATEGORY} k ON k.category = p.category"
_LONG = "CAST(sum({}) AS DECIMAL(18,{}))".format
_RANKED = "(SELECT 'All' AS segment, m.* FROM {mart_customers} m UNION ALL SELECT customer_segment, m.* FROM {mart_customers} m)"
_j = dashboard


def _sections(text: Callable[[str], str]) -> dict[str, tuple[str, str, str]]:
    """Order, item and source of each section; text gives the SQL of a JSON string."""
    return {
        "first_day": ("'0'", text("first_day"), _BOUNDS),
        "last_day": ("'0'", text("last_day"), _BOUNDS),
        "channels": (_j.place("i"), text("channel_name"), f"{_INDEX_CHANNEL} t"),
        "categories": (_j.place("i"), text("category"), f"{_INDEX_CATEGORY} t"),
        "products": (_j.place("t.i"), _j.array(text("product_name"), _j.number("k.i")), f"{{product_index}} t JOIN {_INDEX_CATEGORY} k ON k.category = t.category"),
        "statuses": (_j.place("i"), text("order_status"), f"{_INDEX_STATUS} t"),
        "payments": (_j.place("i"), text("payment_method"), f"{_INDEX_PAYMENT} t"),
        **{f"columns.{n}": ("'0'", "'[' || " + " || ',' || ".join(f"chr(34) || '{x}' || chr(34)" for x in c) + " || ']'", "(SELECT 1 AS one) t") for n, c in dashboard.COLUMNS.items()},
        "sales": (
            _j.place("d", "ch", "cat"), _j.array(*map(_j.number, ("d", "ch", "cat", "net", "units", "gross", "disc", "orders"))),
            f"(SELECT {_D} AS d, ch.i AS ch, k.i AS cat, {NET} AS net, {UNITS} AS units, coalesce({GROSS}, 0) AS gross, coalesce({DISC}, 0) AS disc, {ORDERS} AS orders FROM {{fct_sales}} f CROSS JOIN {_BOUNDS} {_CH} {_CAT} GROUP BY {_D}, ch.i, k.i) t",
        ),
        "sales_orders": (_j.place("d", "ch"), _j.array(*map(_j.number, ("d", "ch", "orders"))), f"(SELECT {_D} AS d, ch.i AS ch, {ORDERS} AS orders FROM {{fct_sales}} f CROSS JOIN {_BOUNDS} {_CH} GROUP BY {_D}, ch.i) t"),
        "product_sales": (
            _j.place("d", "ch", "p"), _j.array(*map(_j.number, ("d", "ch", "p", "net", "units"))),
            f"(SELECT {_D} AS d, ch.i AS ch, x.i AS p, {NET} AS net, {UNITS} AS units FROM {{fct_sales}} f CROSS JOIN {_BOUNDS} {_CH} JOIN {{product_index}} x ON x.product_key = f.product_key GROUP BY {_D}, ch.i, x.i HAVING sum(units_sold) > 0) t",
        ),
        "orders": (
            _j.place("d", "ch", "st", "pay"), _j.array(*map(_j.number, ("d", "ch", "st", "pay", "n", "cancelled", "returned", "billed", "shipping", "hours_sum", "hours_n", "days_sum", "days_n"))),
            f"""(SELECT {_D} AS d, ch.i AS ch, st.i AS st, pm.i AS pay, count(*) AS n, {_CAN} AS cancelled, {_RET} AS returned, {money('sum(billed_amount)')} AS billed, coalesce({_SHIP}, 0) AS shipping, coalesce({_LONG('hours_to_ship', 1)}, 0) AS hours_sum, count(hours_to_ship) AS hours_n,
            coalesce({_LONG('days_to_deliver', 2)}, 0) AS days_sum, count(days_to_deliver) AS days_n FROM {{fct_orders}} f CROSS JOIN {_BOUNDS} {_CH} JOIN {_INDEX_STATUS} st ON st.order_status = f.order_status JOIN {_INDEX_PAYMENT} pm ON pm.payment_method = f.payment_method GROUP BY {_D}, ch.i, st.i, pm.i) t""",
        ),
        "events": (_j.place("d"), _j.record(day=_j.number("d"), sales_event=text("sales_event"), holiday=text("holiday_name")), f"(SELECT CAST(date_day - first_day AS INT) AS d, sales_event, holiday_name FROM {{dim_dates}} CROSS JOIN {_BOUNDS} WHERE date_day BETWEEN first_day AND last_day AND (is_sales_event OR is_public_holiday)) t"),
        "customers.segments": (
            "segment", _j.record(segment=text("segment"), **{n: _j.number(n) for n in ("customers", "buyers", "repeat_buyers", "lifetime_spend")}),
            f"(SELECT {_ALL} AS segment, count(*) AS customers, {_BUY} AS buyers, {_REP} AS repeat_buyers, {money('sum(total_spent)')} AS lifetime_spend FROM {{mart_customers}} GROUP BY GROUPING SETS ((), (customer_segment))) t",
        ),
        "customers.departments": (
            f"segment || {_j.place('place')}", _j.record(segment=text("segment"), department=text("department_code"), net_sales=_j.number("net")),
            f"(SELECT *, row_number() OVER (PARTITION BY segment ORDER BY net DESC, department_code) AS place FROM ({_DEPT}) v) t WHERE place <= 10",
        ),
        "customers.recency": (
            f"segment || {_j.place('days_from')}", _j.record(segment=text("segment"), days_from=_j.number("days_from"), customers=_j.number("customers")),
            f"(SELECT segment, days_from, count(*) AS customers FROM (SELECT segment, CAST(floor(days_since_last_order / 30.0) AS INT) * 30 AS days_from FROM {_RANKED} r WHERE days_since_last_order IS NOT NULL) v GROUP BY segment, days_from) t",
        ),
        "customers.top": (
            f"segment || {_j.place('place')}",
            _j.record(segment=text("segment"), rank=_j.number("place"), name=text("full_name"), id=text("customer_id"), city=text("city"), customer_segment=text("customer_segment"), orders=_j.number("orders"), total_spent=_j.number("total_spent"), last_order=text("last_order_date")),
            f"(SELECT *, row_number() OVER (PARTITION BY segment ORDER BY total_spent DESC, customer_id) AS place FROM {_RANKED} r WHERE total_spent > 0) t WHERE place <= 20",
        ),
        "quality.run_id": ("'0'", text("max(run_id)"), "{q_quality} t"),
        "quality.checked_at": ("'0'", text("max(checked_at)"), "{q_quality} t"),
        "quality.checks": (
            "checked_table || check_name", _j.record(**{"table": text("checked_table"), "check": text("check_name")}, **{n: text(n) for n in ("layer", "dimension", "severity", "status", "description")}), "{q_quality} t WHERE is_latest_run",
        ),
        "quality.rejects": ("lpad(CAST(999999999 - rejected AS STRING), 9, '0') || source || reason", _j.record(source=text("source"), reason=text("reason"), rejected=_j.number("rejected")), "{mart_rejects} t WHERE is_latest_run"),
    }


def _rows(text: Callable[[str], str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS section, {sort} AS sort, {item} AS item FROM {source}" for n, (sort, item, source) in _sections(text).items())


#: DuckDB writes its strings itself.
_DUCK = re.sub(r"\{(\w+)\}", r"\1", _rows(lambda x: f"coalesce(CAST(to_json(CAST({x} AS VARCHAR)) AS VARCHAR), 'null')"))


def _part(name: str, build: Callable[[Shop], DataFrame]) -> None:
    kept = _kept(name, build)
    setattr(Shop, name, kept)
    kept.__set_name__(Shop, name)


# What the sections share is made once: sales by product, and the numbers in place of names. An order has the day, channel and customer of its
# lines, and its sales are theirs, so what no product tells is summed over orders.
_part("page_bounds", lambda s: s.fct_orders.agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day")))
_part("page_sold", lambda s: cubes.sold(s.fct_sales, s.product_index))
_part("page_channels", lambda s: cubes.channel_index(s.dim_channels, s.fct_orders))
_part("page_categories", lambda s: cubes.category_places(s.dim_products, s.page_sold))
_part("page_statuses", lambda s: cubes.status_index(s.fct_orders))
_part("page_payments", lambda s: cubes.payment_index(s.fct_orders))
Shop.page_sales = property(lambda s: cubes.sales_of(s.page_sold, s.fct_sales, s.product_index))
Shop.page_departments = property(lambda s: cubes.departments(s.fct_orders, s.dim_customers, s.mart_customers))
_PARTS = {_BOUNDS: "{page_bounds} b", _INDEX_CHANNEL: "{page_channels}", _INDEX_CATEGORY: "{page_categories}", _INDEX_STATUS: "{page_statuses}", _INDEX_PAYMENT: "{page_payments}", f"({_DEPT})": "{page_departments}"}
#: Sources on Spark of the sections whose facts are aggregated before they meet a name.
_AGGREGATED = {
    "sales": f"""(SELECT {_D} AS d, ch.i AS ch, k.i AS cat, net, units, coalesce(gross, 0) AS gross, coalesce(disc, 0) AS disc, orders FROM {{page_sales}} f CROSS JOIN {_BOUNDS} {_CH} JOIN {_INDEX_CATEGORY} k ON k.category = f.category) t""",
    "sales_orders": f"(SELECT {_D} AS d, ch.i AS ch, orders FROM (SELECT order_date, channel, {_KEPT} AS orders FROM {{fct_orders}} GROUP BY order_date, channel) f CROSS JOIN {_BOUNDS} {_CH}) t",
    "product_sales": f"(SELECT {_D} AS d, ch.i AS ch, p, net, units FROM {{page_sold}} f CROSS JOIN {_BOUNDS} {_CH} WHERE units > 0) t",
    "orders": f"""(SELECT {_D} AS d, ch.i AS ch, st.i AS st, pm.i AS pay, n, cancelled, returned, billed, shipping, hours_sum, hours_n, days_sum, days_n FROM (SELECT order_date, channel, order_status, payment_method, count(*) AS n, {_CAN} AS cancelled, {_RET} AS returned,
      {money('sum(billed_amount)')} AS billed, coalesce({_SHIP}, 0) AS shipping, coalesce({_LONG('hours_to_ship', 1)}, 0) AS hours_sum, count(hours_to_ship) AS hours_n, coalesce({_LONG('days_to_deliver', 2)}, 0) AS days_sum, count(days_to_deliver) AS days_n FROM {{fct_orders}}
      GROUP BY order_date, channel, order_status, payment_method) f CROSS JOIN {_BOUNDS} {_CH} JOIN {_INDEX_STATUS} st ON st.order_status = f.order_status JOIN {_INDEX_PAYMENT} pm ON pm.payment_method = f.payment_method) t""",
}


def _on_spark() -> str:
    made = {n: (sort, item, _AGGREGATED.get(n, source)) for n, (sort, item, source) in _sections(dashboard.text).items()}
    out = " UNION ALL ".join(f"SELECT '{n}' AS section, {sort} AS sort, {item} AS item FROM {source}" for n, (sort, item, source) in made.items())
    for shared, frame in _PARTS.items():
        out = out.replace(shared, frame)
    return out


def _document(s):
    text = _on_spark()
    return s.spark.sql(text, **{f: getattr(s, f) for f in dict.fromkeys(re.findall(r"\{(\w+)\}", text))})


query("dashboard_json", _DUCK)(_document)
query("dashboard_lists", f"SELECT section, '[' || string_agg(item, ',' ORDER BY sort, item) || ']' AS items FROM ({_DUCK}) WHERE section IN ({', '.join(map(repr, dashboard.SHORT))}) GROUP BY section")(lambda s: dashboard.lists(_document(s)))
