"""Gold to a star schema: dimensions with hashed keys and an Unknown member, and the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators import series
from souk.operators.joins import dimension_key


def staged(df: DataFrame, renames: dict[str, str], dropped: tuple[str, ...] = ()) -> DataFrame:
    """A gold table under the names of the warehouse."""
    return df.withColumnsRenamed(renames).drop(*dropped, "_loaded_at")


def dates(order_days: DataFrame, holidays: DataFrame, sales_events: DataFrame, day: str = "order_date", days_ahead: int = 90) -> DataFrame:
    """One row for each day from the first month of order_days to some days after the last. Sales events must not overlap."""
    bounds = order_days.agg(F.trunc(F.min(day), "MM").alias("a"), F.date_add(F.max(day), days_ahead).alias("b"))
    d = F.col("date_day")
    calendar = series.dense_days(bounds, F.col("a"), F.col("b")).select("date_day")
    calendar = calendar.join(holidays.select("holiday_date", "holiday_name"), d == F.col("holiday_date"), "left")
    calendar = series.covering(calendar, "date_day", sales_events, "start_date", "end_date", ["event_name"])
    iso_day = F.weekday(d) + 1
    return calendar.select(
        c.date_key(d).alias("date_key"), "date_day", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"),
        F.expr("extract(yearofweek from date_day)").cast("int").alias("iso_year"), F.weekofyear(d).alias("iso_week"), iso_day.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"), (iso_day >= 6).alias("is_weekend"),
        F.col("holiday_date").isNotNull().alias("is_public_holiday"), "holiday_name", F.col("event_name").isNotNull().alias("is_sales_event"), F.col("event_name").alias("sales_event"),
    )


def channels(orders: DataFrame) -> DataFrame:
    system = F.when(F.col("source") == "marketplace", "Partner marketplace (daily CSV export)").when(F.col("source") == "web_shop", "Own shop (order events)").otherwise(F.col("source"))
    return orders.select("channel", "source").distinct().select("channel", F.initcap("channel").alias("channel_name"), "source", system.alias("source_system"), (F.col("source") == "web_shop").alias("is_own_shop"))


def customers(gold: DataFrame) -> DataFrame:
    names = ("first_name", "last_name", "email", "city", "postal_code", "country", "signup_date")
    known = gold.select(c.surrogate_key("customer_id").alias("customer_key"), "customer_id", F.concat_ws(" ", "first_name", "last_name").alias("full_name"), c.department("postal_code").alias("department_code"), *names)
    unknown = gold.sparkSession.range(1).select(c.unknown_key().alias("customer_key"), F.lit("UNKNOWN").alias("customer_id"), F.lit("Unknown customer").alias("full_name"), F.lit(c.UNKNOWN).alias("city"))
    return known.unionByName(unknown, allowMissingColumns=True)


def products(gold: DataFrame) -> DataFrame:
    known = gold.select(
        c.surrogate_key("product_id").alias("product_key"), "product_id", F.col("name").alias("product_name"), "category", "brand", F.col("unit_price").alias("current_unit_price"), "currency", "is_active",
        F.col("created_at").cast("date").alias("created_date"), F.when(~F.col("is_active"), F.col("updated_at").cast("date")).alias("discontinued_date"),
    )
    unknown = gold.sparkSession.range(1).select(c.unknown_key().alias("product_key"), F.lit("UNKNOWN").alias("product_id"), F.lit("Unknown product").alias("product_name"), F.lit(c.UNKNOWN).alias("category"), F.lit(c.UNKNOWN).alias("brand"), F.lit(False).alias("is_active"))
    return known.unionByName(unknown, allowMissingColumns=True)


def sale_key() -> Column:
    return c.surrogate_key("order_id", "line_number").alias("sale_key")


def sales(lines: DataFrame, orders: DataFrame, dim_customers: DataFrame, dim_products: DataFrame) -> DataFrame:
    """One row for each order line; cancelled orders stay and sell nothing. Customers are looked up by order, before its lines are joined."""
    o = orders.select("order_id", "order_date", "channel", "source", F.col("status").alias("order_status"), "is_cancelled", "is_returned", "customer_id")
    o = dimension_key(o, "customer_id", dim_customers, "customer_id", "customer_key", c.unknown_key()).drop("customer_id")
    joined = lines.drop("source").join(o, "order_id")
    joined = dimension_key(joined, "product_id", dim_products, "product_id", "product_key", c.unknown_key())
    return joined.select(
        sale_key(), "order_id", "line_number", c.date_key("order_date").alias("order_date_key"), "customer_key", "product_key", "order_date", "channel", "source", "order_status", "is_cancelled", "is_returned",
        "quantity", "unit_price", "discount_pct", "gross_amount", "discount_amount", "net_amount", c.zero_if("is_cancelled", "quantity").alias("units_sold"), c.zero_if("is_cancelled", "net_amount").cast(c.MONEY).alias("net_sales_amount"),
    )


def order_facts(orders: DataFrame, dim_customers: DataFrame) -> DataFrame:
    """One row for each order, with durations and amounts that are zero when cancelled."""
    keyed = dimension_key(orders, "customer_id", dim_customers, "customer_id", "customer_key", c.unknown_key())
    return keyed.select(
        "order_id", c.date_key("order_date").alias("order_date_key"), "customer_key", "order_date", "order_ts", "channel", "source", F.col("status").alias("order_status"), "payment_method", "shipping_city", "shipping_postal_code",
        c.department("shipping_postal_code").alias("shipping_department_code"), "is_cancelled", "is_returned", "paid_at", "shipped_at", "delivered_at", "cancelled_at", "returned_at",
        c.elapsed("shipped_at", "order_ts", 3600, 1).alias("hours_to_ship"), c.elapsed("delivered_at", "order_ts", 86400, 2).alias("days_to_deliver"),
        "lines_count", "units", "gross_amount", "discount_amount", "net_amount", "shipping_fee", "total_amount", "source_total_amount",
        c.zero_if("is_cancelled", "units").alias("units_sold"), c.zero_if("is_cancelled", "net_amount").cast(c.MONEY).alias("net_sales_amount"), c.zero_if("is_cancelled", "total_amount").cast(c.MONEY).alias("billed_amount"),
    )
