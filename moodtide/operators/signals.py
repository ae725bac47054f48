"""Completed bars, labels, normalised components, rules on labels, selections and audits. Rows: keys, date, close."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import LABELS, label
from .windows import full_mean, over, series

#: Bars of a one-day move below which volatility is not taken.
FLOOR = 1e-6


def completed(bars: DataFrame, fetched_at: str = "fetched_at", tz: str = "tz") -> DataFrame:
    """Bars before the local date at which their series was retrieved; that day's own bar may still be forming."""
    return bars.filter(F.col("date") < F.to_date(F.from_utc_timestamp(fetched_at, F.col(tz))))


def normalised_label(text: Column, score: Column) -> Column:
    """The band that a label names, whatever its case, separators and spaces; the score's own band if it names none."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[_-]+", " "), r"\s+", " ")
    named = F.coalesce(*(F.when(plain == name.lower(), name) for name in LABELS))
    return F.coalesce(named, label(score))


def clipped(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def floored_sigma(r: Column, keys: list[str], n: int) -> Column:
    """Sample deviation of n daily moves; null until there are n."""
    w = over(keys, n - 1)
    return F.when(F.count(r).over(w) == n, F.greatest(F.stddev_samp(r).over(w), F.lit(FLOOR)))


def sigma_components(bars: DataFrame, keys: list[str]) -> DataFrame:
    """trend (distance from the 200-bar mean), strength (from the 252-bar high), both in deviations over 20 bars, and volatility (20 to
    252 bars), with their scores from 0 to 100; null where a window isn't full."""
    moved = bars.withColumn("r", F.log(F.col("close") / F.lag("close").over(series(keys))))
    unit = floored_sigma(F.col("r"), keys, 63) * F.sqrt(F.lit(20.0))
    high = over(keys, 251)
    top = F.when(F.count("close").over(high) == 252, F.max("close").over(high))
    ratio = floored_sigma(F.col("r"), keys, 20) / floored_sigma(F.col("r"), keys, 252)
    made = moved.select(*keys, "date", (F.log(F.col("close") / full_mean(F.col("close"), keys, 200)) / unit).alias("trend"), (F.log(F.col("close") / top) / unit).alias("strength"), ratio.alias("volatility"))
    return (
        made.withColumn("trend_score", clipped(50 + 25 * F.col("trend"))).withColumn("strength_score", clipped(100 + 50 * F.col("strength")))
        .withColumn("volatility_score", clipped(50 - 50 * F.log2("volatility")))
    )


def relative_appetite(left: DataFrame, right: DataFrame, keys: list[str], n: int = 20) -> DataFrame:
    """appetite and its score: the relative log return over n common bars in deviations of 63 daily ones. left: keys, date, close; right: date, close."""
    pair = left.join(right.select("date", F.col("close").alias("other")), "date").withColumn("x", F.log(F.col("close") / F.col("other")))
    moved = pair.withColumn("r", F.col("x") - F.lag("x").over(series(keys)))
    appetite = (F.col("x") - F.lag("x", n).over(series(keys))) / (floored_sigma(F.col("r"), keys, 63) * F.sqrt(F.lit(float(n))))
    return moved.select(*keys, "date", appetite.alias("appetite")).withColumn("appetite_score", clipped(50 + 25 * F.col("appetite")))


def label_positions(bars: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """position over the bar's interval: in if the label of the bar before is, cash if there is none."""
    return bars.withColumn("position", F.coalesce(F.lag(inside.cast("double")).over(series(keys)), F.lit(0.0)))


def holm_step_down(tests: DataFrame, p: str, family: list[str], ties: list[str], alpha: float = 0.05) -> DataFrame:
    """rank, threshold and rejected: by rising p, none after the first that is above its threshold. A missing p, or one that is none, counts as 1. A family is a bounded set of tests."""
    valid = F.when(F.col(p).between(0, 1) & ~F.isnan(p), F.col(p)).otherwise(1.0)
    w = Window.partitionBy(*family).orderBy("_p", *ties)
    ranked = tests.withColumn("_p", valid).withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumn("threshold", alpha / (F.count("*").over(Window.partitionBy(*family)) - F.col("rank") + 1))
    return ranked.withColumn("rejected", F.min((F.col("_p") <= F.col("threshold")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_p")


def best_active(cells: DataFrame, keys: list[str], *ties: str) -> DataFrame:
    """Of the cells that trade and are not bankrupt the one with the largest wealth; ties by declaration."""
    w = Window.partitionBy(*keys).orderBy(F.desc("wealth"), *ties)
    return cells.filter("turnover > 0 and wealth > 0").withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def as_of_target(rows: DataFrame, orders: DataFrame, keys: list[str]) -> DataFrame:
    """target: that of the last order executed on the row's date or before; null before the first."""
    both = rows.join(orders.select(*keys, F.col("execution").alias("date"), F.col("target").alias("_t")), [*keys, "date"], "left")
    return both.withColumn("target", F.last("_t", ignorenulls=True).over(over(keys))).drop("_t")


def training_windows(rows: DataFrame, keys: list[str], years: int, least: int) -> DataFrame:
    """For each year the rows of the `years` calendar years before it, first and last date, and whether the first of those years begins after the series does and there are `least`."""
    by_year = rows.groupBy(*keys, F.year("date").alias("y")).agg(F.count("*").alias("k"), F.min("date").alias("a"), F.max("date").alias("b"))
    begin = rows.groupBy(*keys).agg(F.min("date").alias("begin"))
    spread = by_year.withColumn("year", F.explode(F.sequence(F.col("y") + 1, F.col("y") + years)))
    out = spread.groupBy(*keys, "year").agg(F.sum("k").alias("n"), F.min("a").alias("first"), F.max("b").alias("last")).join(begin, keys)
    return out.withColumn("eligible", (F.year("begin") <= F.col("year") - years) & (F.col("n") >= least)).drop("begin")
