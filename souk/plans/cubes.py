"""The dashboard's cubes: sales and orders by day and small numbers in place of names, and customers by segment.

Facts are aggregated before a name is looked up, so joins see one row for each day, channel and product or so, and never the facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.operators.rows import top_per_group

#: The order in which statuses are listed; others follow by name.
STATUS_ORDER = ("created", "paid", "shipped", "delivered", "returned", "cancelled")
EVERYONE = "All"


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def total(name: str, where: Column | None = None) -> Column:
    return money(F.sum(name if where is None else F.when(where, F.col(name))))


def _kept() -> Column:
    return ~F.col("is_cancelled")


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0).cast("decimal(18,2)"))


def numbered(names: DataFrame, *order: Column) -> DataFrame:
    """names with i, their place from 0. There are as few as a page can list."""
    return names.withColumn("i", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def channel_index(channels: DataFrame, sales: DataFrame) -> DataFrame:
    """(channel, channel_name, i) by falling net sales; channels without sales are among them."""
    sold = sales.groupBy("channel").agg(F.sum("net_sales_amount").alias("net"))
    known = channels.select("channel", "channel_name").distinct().join(sold, "channel", "left")
    return numbered(known.withColumn("net", _or_zero(F.col("net"))), F.col("net").desc(), F.col("channel_name")).select("channel", "channel_name", "i")


def category_index(products: DataFrame, sales: DataFrame) -> DataFrame:
    """(category, i) by falling net sales."""
    sold = sales.groupBy("product_key").agg(F.sum("net_sales_amount").alias("net"))
    known = products.select("product_key", "category").join(sold, "product_key", "left").groupBy("category").agg(F.sum("net").alias("net"))
    return numbered(known.withColumn("net", _or_zero(F.col("net"))), F.col("net").desc(), F.col("category")).select("category", "i")


def status_index(orders: DataFrame) -> DataFrame:
    """(order_status, i) in the order of an order's life."""
    place = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("order_status"))
    return numbered(orders.select("order_status").distinct(), F.when(place == 0, len(STATUS_ORDER) + 1).otherwise(place), F.col("order_status"))


def payment_index(orders: DataFrame) -> DataFrame:
    """(payment_method, i) by falling number of orders; orders without one come last of a tie."""
    counted = orders.groupBy("payment_method").agg(F.count(F.lit(1)).alias("n"))
    return numbered(counted, F.col("n").desc(), F.col("payment_method").asc_nulls_last()).select("payment_method", "i")


def _indexed(df: DataFrame, index: DataFrame, name: str, as_name: str) -> DataFrame:
    """df with the number of a name; rows whose name is null go."""
    return df.join(index.select(F.col(name), F.col("i").alias(as_name)), name).drop(name)


def sales(facts: DataFrame, channels: DataFrame, products: DataFrame) -> DataFrame:
    """(order_date, channel_i, category_i, net, units, gross, discounts, orders): an order of two categories counts in both."""
    by_category = facts.join(products.select("product_key", "category"), "product_key")
    cube = by_category.groupBy("order_date", "channel", "category").agg(
        total("net_sales_amount").alias("net"), F.sum("units_sold").cast("long").alias("units"), _or_zero(total("gross_amount", _kept())).alias("gross"),
        _or_zero(total("discount_amount", _kept())).alias("discounts"), F.count_distinct(F.when(_kept(), F.col("order_id"))).alias("orders"),
    )
    return _indexed(_indexed(cube, channel_index(channels, facts), "channel", "channel_i"), category_index(products, facts), "category", "category_i")


def sales_orders(facts: DataFrame, channels: DataFrame) -> DataFrame:
    """(order_date, channel_i, orders): each order once, which no sum over categories gives."""
    cube = facts.groupBy("order_date", "channel").agg(F.count_distinct(F.when(_kept(), F.col("order_id"))).alias("orders"))
    return _indexed(cube, channel_index(channels, facts), "channel", "channel_i")


def product_sales(facts: DataFrame, channels: DataFrame, products: DataFrame) -> DataFrame:
    """(order_date, channel_i, product_id, net, units) of what was sold."""
    cube = facts.groupBy("order_date", "channel", "product_key").agg(total("net_sales_amount").alias("net"), F.sum("units_sold").cast("long").alias("units")).where("units > 0")
    named = cube.join(products.select("product_key", "product_id"), "product_key").drop("product_key")
    return _indexed(named, channel_index(channels, facts), "channel", "channel_i")


def orders(facts: DataFrame, lines: DataFrame, channels: DataFrame) -> DataFrame:
    """Orders by day, channel, status and payment. Durations are sums with counts, so that a page can average any selection."""
    cube = facts.groupBy("order_date", "channel", "order_status", "payment_method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_cancelled").alias("cancelled"), F.count_if("is_returned").alias("returned"), total("billed_amount").alias("billed"), _or_zero(total("shipping_fee", _kept())).alias("shipping"),
        _or_zero(total("hours_to_ship")).alias("hours_sum"), F.count("hours_to_ship").alias("hours_n"), _or_zero(total("days_to_deliver")).alias("days_sum"), F.count("days_to_deliver").alias("days_n"),
    )
    for index, name, as_name in ((channel_index(channels, lines), "channel", "channel_i"), (status_index(facts), "order_status", "status_i"), (payment_index(facts), "payment_method", "payment_i")):
        cube = _indexed(cube, index, name, as_name)
    return cube


def sold(facts: DataFrame, index: DataFrame) -> DataFrame:
    """(order_date, channel, p, category, net, units, gross, disc): sales by day, channel and product. index: (product_key, i, category). Facts are
    dealt out once, by product, and meet the index there; whatever is summed over categories, channels or days is summed over these rows."""
    dealt = facts.select("product_key", "order_date", "channel", "net_sales_amount", "units_sold", "is_cancelled", "gross_amount", "discount_amount").repartition("product_key")
    cube = dealt.groupBy("product_key", "order_date", "channel").agg(
        total("net_sales_amount").alias("net"), F.sum("units_sold").cast("long").alias("units"), total("gross_amount", _kept()).alias("gross"), total("discount_amount", _kept()).alias("disc")
    )
    named = index.select("product_key", F.col("i").alias("p"), "category")
    return cube.join(named.hint("shuffle_hash"), "product_key").drop("product_key")


def category_places(products: DataFrame, cube: DataFrame) -> DataFrame:
    """category_index from what sold gives."""
    known = products.select("category", F.lit(None).cast("decimal(18,2)").alias("net")).distinct().unionAll(cube.groupBy("category").agg(total("net")))
    return numbered(known.groupBy("category").agg(_or_zero(total("net")).alias("net")), F.col("net").desc(), F.col("category")).select("category", "i")


def sales_of(cube: DataFrame, facts: DataFrame, index: DataFrame) -> DataFrame:
    """(order_date, channel, category, net, units, gross, disc, orders) from what sold gives; only the orders, which no sum gives, are counted on the facts."""
    own = facts.where(_kept()).select("product_key", "order_date", "channel", "order_id").join(index.select("product_key", "category").hint("shuffle_hash"), "product_key")
    counted = own.select("order_date", "channel", "category", "order_id").distinct().groupBy("order_date", "channel", "category").agg(F.count(F.lit(1)).alias("orders"))
    both = cube.drop("p").unionByName(counted, allowMissingColumns=True)
    sums = [total(x).alias(x) for x in ("net", "gross", "disc")]
    return both.groupBy("order_date", "channel", "category").agg(*sums, F.sum("units").alias("units"), F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"))


def event_days(dates: DataFrame, facts: DataFrame) -> DataFrame:
    """Days of sales or holidays between the first and the last order."""
    bounds = facts.agg(F.min("order_date").alias("first_day"), F.max("order_date").alias("last_day"))
    inside = dates.where("is_sales_event OR is_public_holiday").join(F.broadcast(bounds), F.col("date_day").between(F.col("first_day"), F.col("last_day")))
    return inside.select("date_day", "sales_event", "holiday_name")


def segments(customers: DataFrame) -> DataFrame:
    """(segment, customers, buyers, repeat_buyers, lifetime_spend) of each segment and of all."""
    of = F.when(F.grouping_id("customer_segment") == 1, F.lit(EVERYONE)).otherwise(F.col("customer_segment"))
    found = customers.rollup("customer_segment").agg(of.alias("segment"), F.count(F.lit(1)).alias("customers"), F.count_if(F.col("orders") > 0).alias("buyers"), F.count_if(F.col("orders") >= 2).alias("repeat_buyers"), total("total_spent").alias("lifetime_spend"))
    return found.drop("customer_segment")


def departments(facts: DataFrame, dim: DataFrame, customers: DataFrame) -> DataFrame:
    """(segment, department_code, net): net sales by department, of each segment and of all. Each customer's sales are summed first."""
    bought = facts.groupBy("customer_key").agg(F.sum("net_sales_amount").alias("net_sales_amount"))
    placed = bought.join(dim.select("customer_key", "department_code").where("department_code is not null"), "customer_key").join(customers.select("customer_key", "customer_segment"), "customer_key", "left")
    each = placed.groupBy("customer_segment", "department_code").agg(F.sum("net_sales_amount").alias("net"))
    own = each.select(F.col("customer_segment").alias("segment"), "department_code", money(F.col("net")).alias("net"))
    everyone = each.groupBy("department_code").agg(money(F.sum("net")).alias("net")).select(F.lit(EVERYONE).alias("segment"), "department_code", "net")
    return own.unionAll(everyone)


def top_departments(facts: DataFrame, dim: DataFrame, customers: DataFrame, n: int = 10) -> DataFrame:
    return top_per_group(departments(facts, dim, customers), ["segment"], [F.col("net").desc(), F.col("department_code")], n, "place")
