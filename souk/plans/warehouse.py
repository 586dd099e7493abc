"""The warehouse: its models built from published gold tables, their tests, the rows that fail them, and how fresh its sources are."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators.joins import with_scalar
from souk.operators.lifecycle import STATUSES
from souk.plans import graph, marts, quality, star

#: The generic tests of models, sources and seeds, in the language of quality.CATALOGUE.
CATALOGUE = r"""
core.dim_date
  date_key_unique                uniqueness    error    key: date_key
  date_key_not_null              completeness  error    row: date_key IS NOT NULL
  date_day_unique                uniqueness    error    key: date_day
  date_day_not_null              completeness  error    row: date_day IS NOT NULL
  day_of_week_accepted           validity      error    row: day_of_week IN (1, 2, 3, 4, 5, 6, 7)
core.dim_channels
  channel_unique                 uniqueness    error    key: channel
  channel_not_null               completeness  error    row: channel IS NOT NULL
  source_not_null                completeness  error    row: source IS NOT NULL
core.dim_customers
  customer_key_unique            uniqueness    error    key: customer_key
  customer_key_not_null          completeness  error    row: customer_key IS NOT NULL
  customer_id_unique             uniqueness    error    key: customer_id
  customer_id_not_null           completeness  error    row: customer_id IS NOT NULL
  email_proportion               completeness  warning  99% row: CASE WHEN customer_id <> 'UNKNOWN' THEN email IS NOT NULL END
  postal_code_proportion         completeness  warning  98% row: CASE WHEN customer_id <> 'UNKNOWN' THEN postal_code IS NOT NULL END
core.dim_products
  product_key_unique             uniqueness    error    key: product_key
  product_key_not_null           completeness  error    row: product_key IS NOT NULL
  product_id_unique              uniqueness    error    key: product_id
  product_id_not_null            completeness  error    row: product_id IS NOT NULL
  category_not_null              completeness  error    row: category IS NOT NULL
core.fct_sales
  sale_key_unique                uniqueness    error    key: sale_key
  sale_key_not_null              completeness  error    row: sale_key IS NOT NULL
  order_id_not_null              completeness  error    row: order_id IS NOT NULL
  order_date_key_not_null        completeness  error    row: order_date_key IS NOT NULL
  order_date_key_related         consistency   error    found: order_date_key IN core.dim_date BY date_key
  customer_key_not_null          completeness  error    row: customer_key IS NOT NULL
  customer_key_related           consistency   error    found: customer_key IN core.dim_customers
  product_key_not_null           completeness  error    row: product_key IS NOT NULL
  product_key_related            consistency   error    found: product_key IN core.dim_products
  channel_accepted               validity      error    row: channel IN ({channels})
  channel_related                consistency   error    found: channel IN core.dim_channels
  quantity_range                 validity      error    row: quantity >= 1
  unit_price_range               validity      error    row: unit_price >= 0
  discount_pct_range             validity      error    row: discount_pct BETWEEN 0 AND 100
  net_amount_range               validity      error    row: net_amount >= 0
core.fct_orders
  order_id_unique                uniqueness    error    key: order_id
  order_id_not_null              completeness  error    row: order_id IS NOT NULL
  order_date_key_not_null        completeness  error    row: order_date_key IS NOT NULL
  order_date_key_related         consistency   error    found: order_date_key IN core.dim_date BY date_key
  customer_key_not_null          completeness  error    row: customer_key IS NOT NULL
  customer_key_related           consistency   error    found: customer_key IN core.dim_customers
  channel_not_null               completeness  error    row: channel IS NOT NULL
  channel_related                consistency   error    found: channel IN core.dim_channels
  order_status_accepted          validity      error    row: order_status IN ({statuses})
  hours_to_ship_range            validity      error    row: hours_to_ship >= 0
  days_to_deliver_range          validity      error    row: days_to_deliver >= 0
  shipping_fee_range             validity      error    row: shipping_fee >= 0
  total_amount_range             validity      error    row: total_amount >= 0
marts.mart_daily_sales
  grain_unique                   uniqueness    error    key: date_day, channel, category
  date_day_not_null              completeness  error    row: date_day IS NOT NULL
marts.mart_customers
  customer_key_unique            uniqueness    error    key: customer_key
  customer_key_not_null          completeness  error    row: customer_key IS NOT NULL
  customer_segment_accepted      validity      error    row: customer_segment IN ('No purchase', 'One-time', 'Repeat', 'Loyal')
marts.mart_product_demand_features
  product_key_not_null           completeness  error    row: product_key IS NOT NULL
  date_day_not_null              completeness  error    row: date_day IS NOT NULL
  units_sold_not_null            completeness  error    row: units_sold IS NOT NULL
marts.mart_data_quality
  grain_unique                   uniqueness    error    key: run_id, layer, table_name, check_name
  status_accepted                validity      error    row: status IN ('passed', 'warning', 'failed')
  dimension_accepted             validity      error    row: dimension IN ('completeness', 'uniqueness', 'validity', 'consistency', 'freshness', 'volume')
marts.mart_reject_history
  grain_unique                   uniqueness    error    key: run_id, source, reason
  rejected_range                 validity      error    row: rejected >= 0
lake.orders
  order_id_unique                uniqueness    error    key: order_id
  order_id_not_null              completeness  error    row: order_id IS NOT NULL
lake.order_lines
  order_id_not_null              completeness  error    row: order_id IS NOT NULL
lake.customers
  customer_id_unique             uniqueness    error    key: customer_id
  customer_id_not_null           completeness  error    row: customer_id IS NOT NULL
lake.products
  product_id_unique              uniqueness    error    key: product_id
  product_id_not_null            completeness  error    row: product_id IS NOT NULL
seeds.sales_events
  event_name_not_null            completeness  error    row: event_name IS NOT NULL
  start_date_not_null            completeness  error    row: start_date IS NOT NULL
  end_date_not_null              completeness  error    row: end_date IS NOT NULL
seeds.public_holidays
  holiday_date_unique            uniqueness    error    key: holiday_date
  holiday_date_not_null          completeness  error    row: holiday_date IS NOT NULL
  holiday_name_not_null          completeness  error    row: holiday_name IS NOT NULL
"""
#: Hours since the last load from which a source is late, and from which it is an error.
WARN_HOURS, ERROR_HOURS = 26, 50
#: Fixed value: the share of orders without a known customer from which something is wrong.
UNKNOWN_SHARE = 0.01
#: Tests that only warn.
WARNINGS = ("unknown_customers", "recent_order")


def tests(channels: Sequence[str] = quality.CHANNELS) -> list[quality.Check]:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    return quality.parse(CATALOGUE, statuses=quoted(STATUSES), channels=quoted(channels))


def quarantine(todo: Sequence[quality.Check], frames: Mapping[str, Callable[[], DataFrame]], now: dt.datetime) -> DataFrame:
    """The rows of all tables that fail a generic test, with the test as `failed_test`: one scan a table."""
    found = [quality.failing_rows(frames[name](), [x for x in todo if x.frame == name], frames, now) for name in dict.fromkeys(x.frame for x in todo)]
    return reduce(DataFrame.unionAll, found).withColumn("failed_test", F.concat_ws(".", "layer", "table_name", "check_name"))


#: Who reads the warehouse.
EXPOSURES = {
    "sales_dashboard": "core/dim_date core/dim_channels core/dim_customers core/dim_products core/fct_sales core/fct_orders marts/mart_customers marts/mart_data_quality marts/mart_reject_history".split(),
    "demand_forecast_training_set": ["marts/mart_product_demand_features"],
}


def models() -> graph.Graph:
    """The warehouse's models by what each is made from: gold and quality tables as they were published, the calendar, other models."""
    made = [
        graph.Model("core/dim_date", ("orders", "public_holidays", "sales_events"), lambda t: star.dates(t["orders"], t["public_holidays"], t["sales_events"])),
        graph.Model("core/dim_channels", ("orders",), lambda t: star.channels(t["orders"])),
        graph.Model("core/dim_customers", ("customers",), lambda t: star.customers(t["customers"])),
        graph.Model("core/dim_products", ("products",), lambda t: star.products(t["products"])),
        graph.Model("core/fct_sales", ("order_lines", "orders", "core/dim_customers", "core/dim_products"), lambda t: star.sales(t["order_lines"], t["orders"], t["core/dim_customers"], t["core/dim_products"])),
        graph.Model("core/fct_orders", ("orders", "core/dim_customers"), lambda t: star.order_facts(t["orders"], t["core/dim_customers"])),
        graph.Model("marts/mart_daily_sales", ("core/fct_sales", "core/dim_products", "core/dim_date"), lambda t: marts.daily_sales(t["core/fct_sales"], t["core/dim_products"], t["core/dim_date"])),
        graph.Model("marts/mart_customers", ("core/fct_orders", "core/dim_customers"), lambda t: marts.customer_history(t["core/fct_orders"], t["core/dim_customers"])),
        graph.Model("marts/mart_product_demand_features", ("core/dim_products", "core/fct_sales", "core/dim_date"), lambda t: marts.demand_features(t["core/dim_products"], t["core/fct_sales"], t["core/dim_date"])),
        graph.Model("marts/mart_data_quality", ("quality_check_results",), lambda t: marts.data_quality(t["quality_check_results"])),
        graph.Model("marts/mart_reject_history", ("quality_reject_history",), lambda t: marts.reject_history(t["quality_reject_history"])),
    ]
    return graph.Graph(made, EXPOSURES)


def failing_rows(t: Mapping[str, Callable[[], DataFrame]], today: dt.date) -> dict[str, Callable[[], DataFrame]]:
    """The rows that fail each reconciliation and monitoring test, by name; none where all is well. A test asks for the tables that it looks at
    when its rows are asked for, so a table that no test needs is not made."""
    day = F.lit(today.isoformat()).cast("date")
    total = lambda df, money: df.agg(F.count(F.lit(1)).alias("n"), F.sum(money).alias("amount"))

    def differ(one: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
        renamed = other.select(*[F.col(x).alias(f"other_{x}") for x in columns])
        unequal = [~F.col(x).eqNullSafe(F.col(f"other_{x}")) for x in columns]
        bad = unequal[0]
        for x in unequal[1:]:
            bad = bad | x
        return with_scalar(one.select(*columns), renamed).where(bad)

    orders, sales, features = (lambda: t["fct_orders"]()), (lambda: t["fct_sales"]()), (lambda: t["mart_product_demand_features"]())
    summed = lambda df, net: df.agg(F.sum(net).alias("net_sales"), F.sum("units_sold").alias("units_sold"))

    def orders_and_lines() -> DataFrame:
        by_order = sales().groupBy("order_id").agg(F.sum("quantity").alias("line_units"), F.sum("net_amount").alias("line_net_amount"))
        return orders().join(by_order, "order_id", "left").where("line_units is null or units <> line_units or net_amount <> line_net_amount").select("order_id", "units", "line_units", "net_amount", "line_net_amount")

    def demand_units() -> DataFrame:
        covered = features().agg(F.min("date_day").alias("first_day"), F.max("date_day").alias("last_day"))
        known = with_scalar(sales().where(F.col("product_key") != c.unknown_key()), covered).where("order_date between first_day and last_day")
        return differ(features().agg(F.sum("units_sold").alias("units")), known.agg(F.sum("units_sold").alias("units")), ("units",))

    def unknown_customers() -> DataFrame:
        share = orders().agg(F.count_if(F.col("customer_key") == c.unknown_key()).alias("unknown_orders"), F.count(F.lit(1)).alias("orders"))
        return share.where(F.col("unknown_orders") > UNKNOWN_SHARE * F.col("orders"))

    return {
        "daily_mart": lambda: differ(summed(t["mart_daily_sales"](), "net_sales"), summed(sales(), "net_sales_amount"), ("net_sales", "units_sold")),
        "fact_and_lake": lambda: differ(total(t["order_lines"](), "net_amount"), total(sales(), "net_amount"), ("n", "amount")),
        "orders_and_lines": orders_and_lines,
        "order_steps": lambda: orders().where("shipped_at < order_ts or delivered_at < shipped_at or returned_at < delivered_at").select("order_id", "order_ts", "shipped_at", "delivered_at", "returned_at"),
        "declared_totals": lambda: orders().where("abs(total_amount - source_total_amount) > lines_count * 0.01").select("order_id", "lines_count", "total_amount", "source_total_amount"),
        # a day of margin: the shop may be on the next day already
        "no_future_order": lambda: orders().where(F.col("order_date") > F.date_add(day, 1)).select("order_id", "order_date"),
        "feature_grain": lambda: features().groupBy("product_key", "date_day").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"),
        "demand_units": demand_units,
        "unknown_customers": unknown_customers,
        "recent_order": lambda: orders().agg(F.max("order_date").alias("last_order_date")).where(F.col("last_order_date") < F.date_sub(day, 2)),
    }


def freshness(loaded: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """(name, age_hours, status) of each source by its greatest _loaded_at."""
    out = None
    for name, df in loaded.items():
        age = F.round(F.timestamp_diff("MINUTE", F.max("_loaded_at").cast("timestamp_ntz"), now) / 60, 1)
        one = df.agg(age.alias("age_hours")).select(F.lit(name).alias("name"), "age_hours", F.when(F.col("age_hours") > ERROR_HOURS, "error").when(F.col("age_hours") > WARN_HOURS, "warn").when(F.col("age_hours").isNull(), "error").otherwise("pass").alias("status"))
        out = one if out is None else out.unionAll(one)
    return out
