"""Calendar dimensions: federal holidays, exchange sessions, business days and filing deadlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def days(spark: SparkSession, first: str, last: str) -> DataFrame:
    return spark.sql("select 1").select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))


def nth_weekday(d: Column, month: int, weekday: int, nth: int) -> Column:
    """Whether d is the nth weekday (0: Sunday) of a month."""
    return (F.month(d) == month) & (F.dayofweek(d) - 1 == weekday) & (F.ceil(F.dayofmonth(d) / 7) == nth)


def last_weekday(d: Column, month: int, weekday: int) -> Column:
    return (F.month(d) == month) & (F.dayofweek(d) - 1 == weekday) & (F.dayofmonth(F.date_add(d, 7)) <= 7)


def observed(d: Column, month: int, day: int) -> Column:
    """Whether a fixed holiday is observed on d: Saturday's on Friday, Sunday's on Monday."""
    is_it = lambda x: (F.month(x) == month) & (F.dayofmonth(x) == day)
    w = F.dayofweek(d)
    return (is_it(d) & ~w.isin(1, 7)) | ((w == 6) & is_it(F.date_add(d, 1))) | ((w == 2) & is_it(F.date_sub(d, 1)))


def easter_days(spark: SparkSession, first: int, last: int) -> DataFrame:
    """year and its Easter Sunday (Oudin's form of the Gregorian rule), step by step."""
    div = lambda a, b: F.floor(a / b)
    t = spark.range(first, last + 1).select(F.col("id").alias("year"), (F.col("id") % 19).alias("g"), div(F.col("id"), 100).alias("c"))
    c, h, year = F.col("c"), F.col("h"), F.col("year")
    t = t.withColumn("h", (c - div(c, 4) - div(8 * c + 13, 25) + 19 * F.col("g") + 15) % 30)
    t = t.withColumn("i", h - div(h, 28) * (1 - div(29, h + 1) * div(21 - F.col("g"), 11)))
    t = t.withColumn("p", F.col("i") - (year + div(year, 4) + F.col("i") + 2 - c + div(c, 4)) % 7)
    t = t.withColumn("month", 3 + div(F.col("p") + 40, 44))
    return t.select("year", F.make_date(year.cast("int"), F.col("month").cast("int"), (F.col("p") + 28 - 31 * div(F.col("month"), 4)).cast("int")).alias("easter"))


def federal_holiday(d: Column) -> Column:
    return (
        F.when(observed(d, 1, 1), "New Year's Day").when(nth_weekday(d, 1, 1, 3), "Martin Luther King Jr. Day").when(nth_weekday(d, 2, 1, 3), "Presidents' Day")
        .when(last_weekday(d, 5, 1), "Memorial Day").when(observed(d, 6, 19), "Juneteenth").when(observed(d, 7, 4), "Independence Day").when(nth_weekday(d, 9, 1, 1), "Labor Day")
        .when(nth_weekday(d, 10, 1, 2), "Columbus Day").when(observed(d, 11, 11), "Veterans Day").when(nth_weekday(d, 11, 4, 4), "Thanksgiving Day").when(observed(d, 12, 25), "Christmas Day")
    )


def exchange_closed(d: Column, easter: Column) -> Column:
    """Rule-based full-day closures, given the year's Easter Sunday; a New Year's Day on a Saturday isn't moved to the old year."""
    year = F.year(d)
    new_year = (F.month(d) == 1) & observed(d, 1, 1)
    return (
        F.dayofweek(d).isin(1, 7) | new_year | nth_weekday(d, 2, 1, 3) | last_weekday(d, 5, 1) | observed(d, 7, 4) | nth_weekday(d, 9, 1, 1) | nth_weekday(d, 11, 4, 4) | observed(d, 12, 25)
        | ((year >= 1998) & nth_weekday(d, 1, 1, 3)) | ((year >= 2022) & observed(d, 6, 19)) | (F.date_add(d, 2) == easter)
    )


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """date, is_weekend, holiday, is_business, is_session, and the first business day and the next session from it."""
    d = F.col("date")
    years = easter_days(spark, int(first[:4]), int(last[:4]))  # one row per year
    dated = days(spark, first, last).withColumn("year", F.year("date").cast("long")).join(F.broadcast(years), "year")
    base = dated.select("date", F.dayofweek(d).isin(1, 7).alias("is_weekend"), federal_holiday(d).alias("holiday"), (~exchange_closed(d, F.col("easter"))).alias("is_session"))
    base = base.withColumn("is_business", ~F.col("is_weekend") & F.col("holiday").isNull())
    # one row per day, so a single ordering is small
    ahead = Window.partitionBy(F.lit(0)).orderBy("date")
    roll = F.min(F.when(F.col("is_business"), d)).over(ahead.rowsBetween(0, 14))
    following = F.min(F.when(F.col("is_session"), d)).over(ahead.rowsBetween(1, 14))
    return base.withColumn("business_day", roll).withColumn("next_session", following)


def quarter_end_after(d: Column) -> Column:
    this = F.last_day(F.add_months(F.trunc(d, "quarter"), 2))
    return F.when(this > d, this).otherwise(F.last_day(F.add_months(F.trunc(d, "quarter"), 5)))


def is_quarter_end(d: Column) -> Column:
    return (d == F.last_day(d)) & (F.month(d) % 3 == 0)


def deadlines(reports: DataFrame, dates: DataFrame, report: str, days_after: int) -> DataFrame:
    """For each report date the next quarter end, the day so many days after it, and the business day it rolls to."""
    due = reports.withColumn("quarter_end", quarter_end_after(F.col(report))).withColumn("due", F.date_add("quarter_end", days_after))
    rolled = dates.select(F.col("date").alias("due"), F.col("business_day").alias("deadline"))
    return due.join(rolled, "due", "left").withColumn("rolled", F.col("due") != F.col("deadline"))


def with_reasons(dates: DataFrame) -> DataFrame:
    """A calendar with `reason`: which days stand between a date and the business day it rolls to, null where none does.

    At the calendar's end, where the business day isn't known, the reason is null."""
    d = F.col("date")
    day = F.struct(d.alias("date"), F.when(F.col("is_weekend"), F.date_format(d, "EEEE")).alias("weekend"), F.when(~F.col("is_weekend"), F.col("holiday")).alias("holiday"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(0, 14)  # one row per day
    rows = dates.withColumn("__next", F.collect_list(day).over(ahead)).withColumn("__days", F.filter("__next", lambda x: x["date"] < F.col("business_day")))
    names = lambda c: F.array_distinct(F.array_compact(F.transform("__days", lambda x: x[c])))
    weekend = F.when(F.size(names("weekend")) > 1, "a weekend").when(F.size(names("weekend")) == 1, F.concat(F.lit("a "), names("weekend")[0]))
    named = F.nullif(F.array_join(names("holiday"), " and "), F.lit(""))
    both = F.concat(weekend, F.lit(", and "), named, F.lit(" the next working day"))
    return rows.withColumn("reason", F.coalesce(both, weekend, named)).drop("__next", "__days")
