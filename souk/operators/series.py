"""Days: calendars, ranges, dense series, islands, averages over days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_between(first: Column, last: Column) -> Column:
    """All days from first to last; none where last is earlier."""
    return F.when(first <= last, F.sequence(first, last))


def dense_days(items: DataFrame, first: Column, last: Column, name: str = "date_day") -> DataFrame:
    """Each row of items once for each of its days. Linear in the days, where a range join compares every pair."""
    return items.withColumn(name, F.explode(days_between(first, last)))


def covering(days: DataFrame, day: str, periods: DataFrame, begin: str, end: str, columns: Sequence[str]) -> DataFrame:
    """days with the columns of the period that holds them, null where none does: an equi join on the periods' days."""
    listed = periods.select(F.explode(F.sequence(begin, end)).alias("_day"), *columns)
    return days.join(listed, F.col(day) == F.col("_day"), "left").drop("_day")


def missing_days(first: str, last: str, present: DataFrame, day: str) -> DataFrame:
    """(missing_day): days of the range that present lacks."""
    spark = present.sparkSession
    wanted = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("missing_day"))
    return wanted.join(present.select(F.col(day).alias("missing_day")).distinct(), "missing_day", "left_anti")


def islands(days: DataFrame, group: Sequence[str], day: str) -> DataFrame:
    """(group, first_day, last_day, n_days) of runs of consecutive days."""
    run = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(*group).orderBy(day)))
    return days.select(*group, day).distinct().withColumn("_run", run).groupBy(*group, "_run").agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(F.lit(1)).alias("n_days")).drop("_run")


def trailing_average(daily: DataFrame, day: str, value: str, days: int, name: str, partition: Sequence[str] = ()) -> DataFrame:
    """Average over the last `days` calendar days, days without a row skipped. Without a partition the daily rows, one for
    each day of the calendar, go through one task."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    over = Window.partitionBy(*partition).orderBy(number).rangeBetween(-(days - 1), 0)
    return daily.withColumn(name, F.avg(F.col(value).cast("double")).over(over))
