"""Measures by name: an aggregate over a fact or mart, evaluated for any grouping and filter."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Measure:
    table: str
    value: Callable[[], Column]


def _part(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _total(column: str, where: Column | None = None) -> Column:
    return F.sum(F.col(column) if where is None else F.when(where, F.col(column)))


def _sold() -> Column:
    return ~F.col("is_cancelled")


def _orders() -> Column:
    return F.count_distinct(F.when(_sold(), F.col("order_id")))


def _kept() -> Column:
    return F.count_if(_sold())


def _rows() -> Column:
    return F.count(F.lit(1))


def _at_least(n: int) -> Column:
    return F.count_if(F.col("orders") >= n)


def _checks(status: str) -> Column:
    return F.count_if(F.col("status") == status)


MEASURES: dict[str, Measure] = {
    "net_sales": Measure("sales", lambda: _total("net_sales_amount")),
    "units_sold": Measure("sales", lambda: _total("units_sold")),
    "gross_sales": Measure("sales", lambda: _total("gross_amount", _sold())),
    "discounts": Measure("sales", lambda: _total("discount_amount", _sold())),
    "discount_rate": Measure("sales", lambda: _part(_total("discount_amount", _sold()), _total("gross_amount", _sold()))),
    "orders": Measure("sales", lambda: _orders()),
    "average_basket": Measure("sales", lambda: _part(_total("net_sales_amount"), _orders())),
    "orders_placed": Measure("orders", lambda: _rows()),
    "cancelled_orders": Measure("orders", lambda: F.count_if("is_cancelled")),
    "cancellation_rate": Measure("orders", lambda: _part(F.count_if("is_cancelled"), _rows())),
    "returned_orders": Measure("orders", lambda: F.count_if("is_returned")),
    "return_rate": Measure("orders", lambda: _part(F.count_if("is_returned"), _kept())),
    "billed_amount": Measure("orders", lambda: _total("billed_amount")),
    "shipping_fees": Measure("orders", lambda: _total("shipping_fee", _sold())),
    "average_order_value": Measure("orders", lambda: _part(_total("billed_amount"), _kept())),
    "average_hours_to_ship": Measure("orders", lambda: F.avg(F.col("hours_to_ship").cast("double"))),
    "average_days_to_deliver": Measure("orders", lambda: F.avg(F.col("days_to_deliver").cast("double"))),
    "customers": Measure("customers", lambda: _rows()),
    "buyers": Measure("customers", lambda: _at_least(1)),
    "repeat_buyers": Measure("customers", lambda: _at_least(2)),
    "repeat_rate": Measure("customers", lambda: _part(_at_least(2), _at_least(1))),
    "lifetime_spend": Measure("customers", lambda: _total("total_spent")),
    "average_spend_per_buyer": Measure("customers", lambda: _part(_total("total_spent"), _at_least(1))),
    "checks": Measure("latest_checks", lambda: _rows()),
    "checks_passed": Measure("latest_checks", lambda: _checks("passed")),
    "checks_in_warning": Measure("latest_checks", lambda: _checks("warning")),
    "checks_failed": Measure("latest_checks", lambda: _checks("failed")),
    "pass_rate": Measure("latest_checks", lambda: _part(_checks("passed"), _rows())),
    "rejected_records": Measure("latest_rejects", lambda: _total("rejected")),
    "run_pass_rate": Measure("checks", lambda: _part(_checks("passed"), _rows())),
    "rejected_records_per_run": Measure("rejects", lambda: _total("rejected")),
}
#: Two measures look along the calendar and are frames: previous month, change by month, 7-day average.
CALENDAR_MEASURES = ("net_sales_previous_month", "net_sales_mom", "net_sales_7_day_average")


def evaluate(names: Sequence[str], tables: Mapping[str, DataFrame], by: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """The measures side by side for each group; those of one table in one aggregate."""
    out = None
    for table in dict.fromkeys(MEASURES[n].table for n in names):
        df = tables[table] if where is None else tables[table].where(where)
        own = [MEASURES[n].value().alias(n) for n in names if MEASURES[n].table == table]
        part = df.groupBy(*by).agg(*own)
        out = part if out is None else out.join(part, list(by), "full") if by else out.crossJoin(part)
    return out.select(*by, *names)


def month_over_month(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Net sales by month with the month before and the change. One row a month goes through the window."""
    monthly = sales.groupBy("order_date_key").agg(F.sum("net_sales_amount").alias("n")).join(dates.select("date_key", "year_month"), F.col("order_date_key") == F.col("date_key")).groupBy("year_month").agg(F.sum("n").cast("decimal(18,2)").alias("net_sales"))
    before = F.lag("net_sales").over(Window.orderBy("year_month"))
    return monthly.withColumn("previous_month", before).withColumn("change", F.round(_part(F.col("net_sales") - F.col("previous_month"), F.col("previous_month")), 6))
