"""The retail calendar of France by rule: feasts that move with Easter, sales that begin on a Wednesday, the week of Black Friday.

All are column expressions of a year, so days of any number of years are rows that Spark makes; no list of dates is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public holidays by month and day, and by days after Easter Sunday.
FIXED = {"New Year's Day": (1, 1), "Labour Day": (5, 1), "Victory in Europe Day": (5, 8), "Bastille Day": (7, 14), "Assumption Day": (8, 15), "All Saints' Day": (11, 1), "Armistice Day": (11, 11), "Christmas Day": (12, 25)}
MOVING = {"Easter Monday": 1, "Ascension Day": 39, "Whit Monday": 50}
#: The days that sales last.
SALES_DAYS = 28
WEDNESDAY, THURSDAY = 2, 3


def day(year: Column, month: int, of_month: int) -> Column:
    return F.make_date(year, F.lit(month), F.lit(of_month))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the first full moon of spring, by the church's tables."""
    whole = lambda x, n: F.floor(x / n).cast("int")
    century = whole(year, 100)
    # days from 21 March to the full moon, then to the Sunday after it
    moon = (19 * (year % 19) + century - whole(century, 4) - whole(century - whole(century + 8, 25) + 1, 3) + 15) % 30
    moon = moon - F.when((moon == 29) | ((moon == 28) & (year % 19 > 10)), 1).otherwise(0)
    full = F.date_add(day(year, 3, 21), moon)
    return F.date_add(full, 7 - (F.weekday(full) + 1) % 7)


def first_weekday(from_day: Column, weekday: int) -> Column:
    """The first such weekday (Monday 0) on or after a day."""
    return F.date_add(from_day, (weekday - F.weekday(from_day) + 7) % 7)


def winter_sales(year: Column) -> Column:
    """The second Wednesday of January, or the first if the second comes after the 12th."""
    first = first_weekday(day(year, 1, 1), WEDNESDAY)
    return F.when(F.dayofmonth(first) + 7 <= 12, F.date_add(first, 7)).otherwise(first)


def summer_sales(year: Column) -> Column:
    """The last Wednesday of June, or the one before if the last comes after the 28th."""
    last = first_weekday(day(year, 6, 24), WEDNESDAY)
    return F.when(F.dayofmonth(last) > 28, F.date_sub(last, 7)).otherwise(last)


def black_friday(year: Column) -> Column:
    """The day after the fourth Thursday of November."""
    return F.date_add(first_weekday(day(year, 11, 22), THURSDAY), 1)


def holidays(years: DataFrame) -> DataFrame:
    """(holiday_date, holiday_name) of the years (column year). Holidays that fall on one day are one row with both names."""
    y = F.col("year").cast("int")
    named = [F.struct(day(y, *md).alias("d"), F.lit(n).alias("n")) for n, md in FIXED.items()] + [F.struct(F.date_add(easter(y), k).alias("d"), F.lit(n).alias("n")) for n, k in MOVING.items()]
    each = years.select("year").distinct().select(F.explode(F.array(*named)).alias("x"))
    return each.groupBy(F.col("x.d").alias("holiday_date")).agg(F.array_join(F.sort_array(F.collect_set("x.n")), " / ").alias("holiday_name"))


def sales_events(years: DataFrame) -> DataFrame:
    """(event_name, start_date, end_date) of the years: both sales, and the week from Monday to the Monday after Black Friday."""
    y = F.col("year").cast("int")
    span = lambda name, first, last: F.struct(F.lit(name).alias("event_name"), first.alias("start_date"), last.alias("end_date"))
    spans = [span(n, f, F.date_add(f, SALES_DAYS - 1)) for n, f in (("Winter sales", winter_sales(y)), ("Summer sales", summer_sales(y)))]
    spans.append(span("Black Friday", F.date_sub(black_friday(y), 4), F.date_add(black_friday(y), 3)))
    return years.select("year").distinct().select(F.explode(F.array(*spans)).alias("x")).select("x.*")


def years_of(days: DataFrame, column: str, days_ahead: int = 90) -> DataFrame:
    """(year) of all years from the first day of a column to some days after the last; none for an empty table."""
    bounds = days.agg(F.year(F.min(column)).alias("a"), F.year(F.date_add(F.max(column), days_ahead)).alias("b")).where("a is not null")
    return bounds.select(F.explode(F.sequence("a", "b")).alias("year"))
