"""The six-component sentiment composite."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

KEY = ["market"]


def components(index: DataFrame, slots: dict[str, DataFrame]) -> DataFrame:
    """market, component, date, raw: index and slots are bars by market."""
    parts = {
        "momentum": W.momentum(index, KEY),
        "strength": W.strength(index, KEY),
        "volatility": W.relative_to_mean(W.realised_vol(index, KEY), KEY),
        "safeHaven": W.return_gap(index, slots["bond"], KEY),
        "credit": W.ratio_vs_mean(slots["hy"], slots["ig"], KEY, 125),
        "breadth": W.ratio_vs_mean(slots["small"], slots["large"], KEY, 63),
    }
    return reduce(DataFrame.unionByName, (p.withColumn("component", F.lit(k)) for k, p in parts.items()))


def scored(parts: DataFrame) -> DataFrame:
    """With percentile scores; high volatility is fear."""
    ranked = W.expanding_midrank(parts, ["market", "component"])
    return ranked.withColumn("score", F.when(F.col("component") == "volatility", 100 - F.col("score")).otherwise(F.col("score")))


def composite(index: DataFrame, scores: DataFrame, least: int = 6, days: int = 7) -> DataFrame:
    """market, date, score, n: the mean of the components' scores as of each index date, where at least `least` are fresh."""
    fresh = W.as_of(index, scores.filter("score is not null"), KEY, ["score", "raw"], days, ("component",)).filter("score is not null")
    mean = fresh.groupBy("market", "date").agg(F.avg("score").alias("score"), F.count("*").cast("int").alias("n"))
    return mean.filter(F.col("n") >= least)


def lookback(history: DataFrame) -> DataFrame:
    """One row per market: the last score and those at or before a week, a month and a year ago, and the previous one."""
    last = F.max("date").over(W.Window.partitionBy("market"))
    aged = history.withColumn("last", last).withColumn("place", F.row_number().over(W.Window.partitionBy("market").orderBy(F.desc("date"))))
    ago = lambda n: F.max_by("score", F.when(F.col("date") <= F.date_sub("last", n), F.col("date")))
    return aged.groupBy("market").agg(
        F.max("date").alias("date"), F.max_by("score", "date").alias("score"), F.max(F.when(F.col("place") == 2, F.col("score"))).alias("previous"), ago(7).alias("week"), ago(30).alias("month"), ago(365).alias("year")
    )
