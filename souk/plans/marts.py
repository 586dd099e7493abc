"""Marts over the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators.joins import with_scalar
from souk.operators.series import dense_days


def sold() -> Column:
    """Whether a fact counts as sold."""
    return ~F.col("is_cancelled")


def daily_sales(sales: DataFrame, products: DataFrame, dates: DataFrame) -> DataFrame:
    """Day, channel and category. orders counts an order in each of its categories."""
    calendar = ("date_day", "year", "year_month", "iso_week", "day_name", "is_weekend", "is_public_holiday", "sales_event")
    # summed by day key and category first: the calendar's columns are joined to the result only
    facts = sales.join(products.select("product_key", "category"), "product_key")
    zero = F.lit(0).cast(c.MONEY)
    summed = facts.groupBy("order_date_key", "channel", "category").agg(
        F.count_distinct(F.when(sold(), F.col("order_id"))).alias("orders"),
        F.sum("units_sold").cast("long").alias("units_sold"),
        F.sum(F.when(sold(), F.col("gross_amount"))).alias("gross_sales"),
        F.sum(F.when(sold(), F.col("discount_amount"))).alias("discounts"),
        F.sum("net_sales_amount").alias("net_sales"),
        F.count_distinct(F.when(F.col("is_cancelled"), F.col("order_id"))).alias("cancelled_orders"),
        F.coalesce(F.sum(F.when(F.col("is_cancelled"), F.col("net_amount"))), zero).alias("cancelled_amount"),
        F.count_distinct(F.when(F.col("is_returned"), F.col("order_id"))).alias("returned_orders"),
        F.coalesce(F.sum(F.when(F.col("is_returned"), F.col("net_amount"))), zero).alias("returned_amount"),
    )
    money = ("gross_sales", "discounts", "net_sales", "cancelled_amount", "returned_amount")
    return summed.withColumns({m: F.col(m).cast("decimal(18,2)") for m in money}).join(dates.select("date_key", *calendar), F.col("order_date_key") == F.col("date_key")).drop("order_date_key", "date_key")


def customer_history(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row for each known customer; recency counts from the last order day in the data."""
    history = orders.groupBy("customer_key").agg(
        F.count(F.lit(1)).alias("orders_placed"), F.count_if(sold()).alias("orders"), F.count_if("is_cancelled").alias("cancelled_orders"), F.count_if("is_returned").alias("returned_orders"),
        F.min(F.when(sold(), F.col("order_date"))).alias("first_order_date"), F.max(F.when(sold(), F.col("order_date"))).alias("last_order_date"), F.sum("units_sold").cast("long").alias("units_bought"), F.sum("billed_amount").cast("decimal(18,2)").alias("total_spent"),
    )
    known = customers.where(F.col("customer_key") != c.unknown_key()).join(history, "customer_key", "left")
    counts = {x: F.coalesce(x, F.lit(0)) for x in ("orders_placed", "orders", "cancelled_orders", "returned_orders", "units_bought")}
    mean = F.round(F.try_divide("total_spent", F.nullif(F.col("orders"), F.lit(0))), 2).cast("decimal(18,2)")
    filled = with_scalar(known, orders.agg(F.max("order_date").alias("as_of"))).withColumn("average_order_value", mean).withColumns(counts).withColumn("total_spent", F.coalesce("total_spent", F.lit(0)).cast("decimal(18,2)"))
    return filled.select(
        "customer_key", "customer_id", "full_name", "city", "department_code", "signup_date", "orders_placed", "orders", "cancelled_orders", "returned_orders", "first_order_date", "last_order_date", "units_bought", "total_spent",
        "average_order_value", F.datediff("as_of", "last_order_date").alias("days_since_last_order"), c.segment("orders").alias("customer_segment"),
    )


def daily_demand(sales: DataFrame, parts: int | None = None) -> DataFrame:
    """Product and day: what sold, at what price and discount. Facts are dealt out by product, into so many parts if told: that is one shuffle, and
    distinct orders need no other."""
    facts = ("product_key", "order_date_key", "order_id", "is_cancelled", "unit_price", "gross_amount", "discount_amount", "units_sold", "net_sales_amount")
    sales = sales.select(*facts).repartition(*([parts] if parts else []), "product_key")
    rate = F.try_divide(F.sum(F.when(sold(), F.col("discount_amount"))).cast("double"), F.sum(F.when(sold(), F.col("gross_amount"))).cast("double"))
    return sales.groupBy("product_key", "order_date_key").agg(
        F.sum("units_sold").cast("long").alias("units_sold"), F.count_distinct(F.when(sold(), F.col("order_id"))).alias("orders"), F.sum("net_sales_amount").cast("decimal(18,2)").alias("net_sales"),
        F.round(F.avg(F.when(sold(), F.col("unit_price"))), 2).cast("decimal(18,2)").alias("average_unit_price"), F.round(rate, 4).alias("discount_rate"),
    )


#: Product days that a task makes and puts in order: some hundred MB.
DAYS_PER_TASK = 2_000_000


def _on_sale(products: DataFrame, sales: DataFrame) -> tuple[DataFrame, int]:
    """(known products with the first and last day that they were on sale, dealt out by product; into how many parts): as many as their days
    ask for, as the products themselves are few bytes."""
    period = sales.agg(F.min("order_date").alias("first_day"), F.date_sub(F.max("order_date"), 1).alias("last_day"))
    last = F.least(F.coalesce("discontinued_date", "last_day"), F.col("last_day"))
    dated = with_scalar(products.where(F.col("product_key") != c.unknown_key()), period).select("product_key", "product_id", "category", "brand", F.greatest("created_date", "first_day").alias("first_day"), last.alias("last_day")).where("first_day <= last_day")
    days = dated.agg(F.sum(F.datediff("last_day", "first_day") + 1)).first()[0] or 0
    n = days // DAYS_PER_TASK + 1
    return dated.repartition(n, "product_key"), n


def product_days(products: DataFrame, sales: DataFrame) -> DataFrame:
    """Every day each known product was on sale, up to the day before the last order day."""
    return dense_days(_on_sale(products, sales)[0], F.col("first_day"), F.col("last_day")).select("product_key", "product_id", "category", "brand", "date_day")


#: How many days back past demand is told, and over how many days before it is averaged.
LAGS, SPANS = (1, 7, 14), (7, 28)


def demand_stretches(products: DataFrame, sales: DataFrame, lags: tuple[int, ...] = LAGS, spans: tuple[int, ...] = SPANS) -> DataFrame:
    """Product and stretch of days over which no feature changes: _first and _last count the days since it went on sale, first_day.

    Facts and products are dealt out by product, one row a product; stretches and days meet no shuffle. What sold on a day moves features on
    that day and on a few days after it, so a product has some stretches for each day that sold, however many its days: two or three where no past is asked for. Past demand is a
    difference of running sums, which are exact, as units are whole; _before[k] has the units of a product's first k days."""
    on_sale, n = _on_sale(products, sales)
    day = F.make_date((F.col("order_date_key") / 10000).cast("int"), (F.col("order_date_key") / 100).cast("int") % 100, F.col("order_date_key") % 100)
    told = ("units_sold", "orders", "net_sales", "average_unit_price", "discount_rate")
    zero = {"units_sold": F.lit(0), "orders": F.lit(0), "net_sales": F.lit(0).cast("decimal(18,2)")}
    sold = daily_demand(sales, n).groupBy("product_key").agg(F.collect_list(F.struct(day.alias("_day"), *told)).alias("_sold"))
    inside = F.filter(F.coalesce("_sold", F.array()), lambda x: x["_day"].between(F.col("first_day"), F.col("last_day")))
    each = on_sale.join(sold, "product_key", "left").withColumn("_sold", F.array_sort(inside)).withColumn("_days", F.datediff("last_day", "first_day") + 1)
    each = each.withColumns({"_at": F.transform("_sold", lambda x: F.datediff(x["_day"], "first_day")), "_sums": F.aggregate("_sold", F.array(F.lit(0).cast("long")), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + F.coalesce(x["units_sold"], F.lit(0)))))})
    moves = sorted({0, 1, *lags, *(x + 1 for x in (*lags, *spans))})
    starts = F.concat(F.sequence(F.lit(0), F.lit(max((0, *lags, *spans)))), F.flatten(F.transform("_at", lambda k: F.array(*[k + m for m in moves]))))
    edges = each.withColumns({"_edges": F.concat(F.array(F.lit(-1)), "_at", F.array("_days")), "_starts": F.sort_array(F.array_distinct(F.filter(starts, lambda k: k < F.col("_days"))))})
    runs = F.transform("_sums", lambda units, i: F.array_repeat(units, F.get("_edges", i + 1) - F.get("_edges", i)))
    stretches = F.transform("_starts", lambda k, i: F.struct(k.alias("_first"), (F.coalesce(F.get("_starts", i + 1), F.col("_days")) - 1).alias("_last")))
    whole = edges.select("product_key", "product_id", "category", "brand", "first_day", "_sold", "_at", F.flatten(runs).alias("_before"), stretches.alias("_stretches"))
    k = F.col("_first")
    before = lambda i: F.get("_before", i)
    own = lambda x: F.get("_sold", F.array_position("_at", k).cast("int") - 1)[x]
    lag = lambda n: (before(k - n + 1) - before(k - n)).alias(f"units_sold_lag_{n}")
    mean = lambda n: F.round(F.try_divide((before(k) - before(F.greatest(k - n, F.lit(0)))).cast("double"), F.least(k, F.lit(n)).cast("double")), 3).alias(f"units_sold_avg_{n}d")
    # outer, though no list is empty: that lists are not empty would be asked below, with all that they are made of once more
    return whole.withColumn("_x", F.explode_outer("_stretches")).select("*", "_x.*").select(
        "product_key", "product_id", "category", "brand", "first_day", "_first", "_last", *[(F.coalesce(own(x), zero[x]) if x in zero else own(x)).alias(x) for x in told], *map(lag, lags), *map(mean, spans)
    )


def demand_features(products: DataFrame, sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Product and day with past demand that ends the day before: the days of each stretch."""
    calendar = ("day_of_week", "is_weekend", "month", "is_public_holiday", "is_sales_event", "sales_event")
    stretches = demand_stretches(products, sales)
    made = [x for x in stretches.columns if x not in ("product_key", "product_id", "category", "brand", "first_day", "_first", "_last")]
    days = stretches.withColumn("_k", F.explode(F.sequence("_first", "_last"))).withColumn("date_day", F.date_add("first_day", F.col("_k")))
    featured = days.select("product_key", "product_id", "date_day", "category", "brand", *made, F.col("_k").cast("long").alias("days_on_sale"))
    known = F.broadcast(dates.select(F.col("date_day").alias("_day"), *calendar))
    return featured.join(known, F.col("date_day") == F.col("_day")).drop("_day")


def stretch_days() -> Column:
    """How many days a stretch has: as many rows of the feature table."""
    return F.col("_last") - F.col("_first") + 1


def feature_grain(stretches: DataFrame) -> DataFrame:
    """(rows, product_days) of the feature table: how many rows it has, and how many of them differ in product and day. A product's stretches are gone
    through in order, so a day that two of them hold counts twice as rows and once as a day."""
    spans = F.collect_list(F.struct(F.date_add("first_day", F.col("_first")).alias("a"), F.date_add("first_day", F.col("_last")).alias("b")))
    none = F.struct(F.lit(0).cast("long").alias("days"), F.lit(None).cast("date").alias("upto"))

    def met(seen: Column, x: Column) -> Column:
        begin = F.greatest(x["a"], F.date_add(seen["upto"], 1))
        return F.struct((seen["days"] + F.greatest(F.datediff(x["b"], begin) + 1, F.lit(0))).alias("days"), F.greatest(seen["upto"], x["b"]).alias("upto"))

    each = stretches.groupBy("product_key").agg(F.sum(stretch_days()).alias("rows"), F.array_sort(spans).alias("_spans"))
    return each.select("rows", F.aggregate("_spans", none, met)["days"].alias("days")).agg(F.sum("rows").alias("rows"), F.sum("days").alias("product_days"))


def demand_totals(products: DataFrame, sales: DataFrame, dates: DataFrame) -> DataFrame:
    """The feature table summed up by product. A stretch counts as often as it has days; the calendar, which has every day, is summed up from its
    first day on, so that a stretch's weekends are a difference of two sums."""
    marks = {"is_weekend": "weekend_days", "is_sales_event": "event_days", "is_public_holiday": "holidays_met"}
    running = Window.orderBy("date_day").rowsBetween(Window.unboundedPreceding, 0)
    summed = dates.select("date_day", *[F.sum(F.col(x).cast("long")).over(running).alias(x) for x in marks], *[F.col(x).cast("long").alias(f"own_{x}") for x in marks])
    first = F.broadcast(summed.select(F.col("date_day").alias("_a"), *[(F.col(x) - F.col(f"own_{x}")).alias(f"before_{x}") for x in marks]))
    last = F.broadcast(summed.select(F.col("date_day").alias("_b"), *marks))
    n = stretch_days()
    stretches = demand_stretches(products, sales)
    met = stretches.join(first, F.date_add("first_day", F.col("_first")) == F.col("_a")).join(last, F.date_add("first_day", F.col("_last")) == F.col("_b"))
    total = lambda x, name: F.sum(F.col(x) * n).cast("long").alias(name)
    # averages are whole thousandths: their sums are exact as whole numbers
    mean = lambda d: (F.sum(F.rint(F.col(f"units_sold_avg_{d}d") * 1000).cast("long") * n).cast("decimal(18,0)") * F.lit(0.001).cast("decimal(3,3)")).cast("decimal(18,3)").alias(f"avg{d}")
    return met.groupBy("product_id").agg(
        F.sum(n).cast("long").alias("days"), total("units_sold", "units"), *[total(f"units_sold_lag_{d}", f"lag{d}") for d in LAGS], *map(mean, SPANS), F.max("_last").cast("long").alias("days_on_sale"),
        *[F.sum(F.col(x) - F.col(f"before_{x}")).cast("long").alias(name) for x, name in marks.items()], total("orders", "orders"),
    )


def reject_history(history: DataFrame) -> DataFrame:
    """(run, source, reason) with the change since the run before."""
    over = Window.partitionBy("source", "reason").orderBy("checked_at")
    latest = history.agg(F.max("checked_at").alias("_latest"))
    return with_scalar(history, latest).select("run_id", "checked_at", F.col("checked_at").cast("date").alias("checked_date"), (F.col("checked_at") == F.col("_latest")).alias("is_latest_run"), "source", "reason", "rejected", (F.col("rejected") - F.lag("rejected").over(over)).alias("change_since_previous_run"))


def data_quality(results: DataFrame) -> DataFrame:
    """(run, check) with whether it is of the latest run and whether it is a problem."""
    latest = results.agg(F.max("checked_at").alias("_latest"))
    kept = ("layer", "table_name", "check_name", "dimension", "severity", "description", "column_name", "status", "element_count", "unexpected_count", "unexpected_percent", "observed_value", "sample")
    return with_scalar(results, latest).select("run_id", "checked_at", F.col("checked_at").cast("date").alias("checked_date"), (F.col("checked_at") == F.col("_latest")).alias("is_latest_run"), F.concat_ws(".", "layer", "table_name").alias("checked_table"), (F.col("status") != "passed").alias("is_problem"), *kept)
