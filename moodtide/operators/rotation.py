"""Portfolios of several assets and cash: targets from relative and absolute momentum, and wealth between exact rebalances.

A panel (one or more keys) is a set of assets with one row a day: `closes`, an array of (asset, close) by name, and `cash`, the
wealth of an account that holds cash. What is kept at a rebalance depends on the weights before and after it alone, so wealth is a
product over segments and needs no step from day to day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import years_between
from .windows import over, series

STALE_DAYS = 7


def common_rows(bars: DataFrame, keys: list[str], asset: str, n: int) -> DataFrame:
    """keys, date, closes: the dates on which all n assets have a positive close. An asset given twice on a date leaves the date out."""
    sound = bars.filter((F.col("close") > 0) & ~F.isnan("close"))
    rows = sound.groupBy(*keys, "date").agg(F.array_sort(F.collect_list(F.struct(F.col(asset).alias("asset"), "close"))).alias("closes"))
    distinct = F.size(F.array_distinct(F.transform("closes", lambda x: x["asset"])))
    return rows.filter((F.size("closes") == n) & (distinct == n))


def anniversaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last row of each month that has one after it, with the latest row up to seven days before or on the date twelve months earlier.

    keys, date, execution (the next row's date), reference, closes, cash, and both of the reference; months without a reference are left out."""
    w = series(keys)
    month = Window.partitionBy(*keys, F.trunc("date", "month")).orderBy(F.desc("date"))
    ends = rows.withColumn("execution", F.lead("date").over(w)).withColumn("__k", F.row_number().over(month)).filter("__k = 1 and execution is not null").drop("__k")
    # eight days each instead of a range join
    tried = ends.withColumn("reference", F.explode(F.transform(F.sequence(F.lit(0), F.lit(STALE_DAYS)), lambda k: F.date_sub(F.add_months("date", -12), k))))
    before = rows.select(*keys, F.col("date").alias("reference"), F.col("closes").alias("closes_before"), F.col("cash").alias("cash_before"))
    found = tried.join(before, [*keys, "reference"])
    latest = Window.partitionBy(*keys, "date").orderBy(F.desc("reference"))
    return found.withColumn("__k", F.row_number().over(latest)).filter("__k = 1").drop("__k")


def momentum_targets(signals: DataFrame) -> DataFrame:
    """Adds cash_return, ranking (return, place and asset, best first, ties by name) and the weights `top1` and `top2`, aligned with closes.

    top1 holds the best asset, top2 half each of the best two; one that didn't rise more than cash is left in cash."""
    rise = F.zip_with("closes", "closes_before", lambda a, b: F.struct((1 - a["close"] / b["close"]).alias("fall"), a["asset"].alias("asset"), (a["close"] / b["close"] - 1).alias("rise")))
    out = signals.withColumn("cash_return", F.col("cash") / F.col("cash_before") - 1).withColumn("ranking", F.array_sort(rise))
    held = lambda n: F.transform(F.filter(F.slice("ranking", 1, n), lambda x: x["rise"] > F.col("cash_return")), lambda x: x["asset"])
    weights = lambda n: F.transform("closes", lambda x: F.when(F.array_contains(held(n), x["asset"]), 1.0 / n).otherwise(0.0))
    return out.withColumn("top1", weights(1)).withColumn("top2", weights(2))


def kept(before: Column, after: Column, cost: Column) -> Column:
    """The share of wealth left by trading from weights to weights (arrays, aligned): the root of f + cost * sum |after * f - before| = 1.

    The left side is convex and piecewise linear, so Newton's steps from 1 reach the root after at most one step for each kink."""
    pairs = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda f, value: F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + value(f, x))

    def step(f, _):
        excess = f + cost * total(f, lambda f, x: F.abs(x["b"] * f - x["a"])) - 1
        slope = 1 + cost * total(f, lambda f, x: F.when(x["b"] * f > x["a"], x["b"]).otherwise(-x["b"]))
        return f - excess / slope

    return F.aggregate(F.sequence(F.lit(0), F.size(before)), F.lit(1.0), step)


def traded(before: Column, after: Column, f: Column) -> Column:
    return F.aggregate(F.zip_with(before, after, lambda a, b: F.abs(b * f - a)), F.lit(0.0), lambda acc, x: acc + x)


def wealth(rows: DataFrame, targets: DataFrame, keys: list[str], costs: list[float]) -> DataFrame:
    """The curve of each strategy and cost from its first execution to the end, where all is sold.

    rows as above; targets: keys, strategy, execution, weights (aligned with closes, none negative, at most 1 in all). Starts in cash at wealth 1; trades at the close of the
    execution, after that day's move. One strategy's two targets for one day are an error of the caller. keys, strategy, cost, date, wealth, turnover (amounts traded that day), trades."""
    by = [*keys, "strategy"]
    first = targets.groupBy(*by).agg(F.min("execution").alias("__first"))
    path = rows.select(*keys, "date", F.transform("closes", lambda x: x["close"]).alias("p"), "cash").join(first, keys).filter("date >= __first")
    path = path.join(targets.select(*by, F.col("execution").alias("date"), "weights"), [*by, "date"], "left").withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    by_cost = [*by, "cost"]
    w = series(by_cost)
    start = F.when(F.col("weights").isNotNull(), F.struct("p", F.col("cash").alias("c"), F.col("weights").alias("w")))
    path = path.withColumn("__s", F.last(start, ignorenulls=True).over(over(by_cost).rowsBetween(Window.unboundedPreceding, -1)))
    # values since the last rebalance, of one unit then; on the first row all is cash
    risky = F.when(F.col("__s").isNull(), F.transform("p", lambda x: F.lit(0.0))).otherwise(F.zip_with(F.zip_with("p", "__s.p", lambda a, b: a / b), "__s.w", lambda g, x: g * x))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    idle = F.coalesce((1 - add(F.col("__s.w"))) * F.col("cash") / F.col("__s.c"), F.lit(1.0))
    path = path.withColumn("__v", risky).withColumn("__total", add(F.col("__v")) + idle).withColumn("__v", F.transform("__v", lambda x: x / F.col("__total")))
    path = path.withColumn("__f", F.when(F.col("weights").isNotNull(), kept(F.col("__v"), F.col("weights"), F.col("cost"))))
    cum = F.sum(F.when(F.col("__f").isNotNull(), F.log(F.col("__total") * F.col("__f"))))
    earlier = F.exp(F.coalesce(cum.over(over(by_cost).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) * F.col("__total")
    path = path.withColumn("__gross", earlier).withColumn("__net", earlier * F.coalesce("__f", F.lit(1.0)))
    moved = F.when(F.col("__f").isNotNull(), traded(F.col("__v"), F.col("weights"), F.col("__f"))).otherwise(0.0)
    path = path.withColumn("__moved", moved).withColumn("__end", F.lead("date").over(w).isNull())
    sold = F.when(F.col("__end"), F.coalesce(add(F.col("weights")), add(F.col("__v")))).otherwise(0.0)
    path = path.withColumn("__sold", sold)
    amount = F.col("__gross") * F.col("__moved") + F.col("__net") * F.col("__sold")
    n = (F.col("__moved") > 1e-14).cast("int") + (F.col("__net") * F.col("__sold") > 1e-14).cast("int")
    return path.select(*by_cost, "date", (F.col("__net") * (1 - F.col("cost") * F.col("__sold"))).alias("wealth"), amount.alias("turnover"), n.alias("trades"))


def summary(curve: DataFrame, by: list[str]) -> DataFrame:
    """Of each curve its span, final wealth, growth and volatility a year, the largest fall from a peak, what was traded and how often."""
    w = series(by)
    rows = curve.withColumn("__r", F.log(F.col("wealth") / F.lag("wealth").over(w))).withColumn("__fall", 1 - F.col("wealth") / F.max("wealth").over(over(by)))
    s = rows.groupBy(*by).agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("rows"), F.max_by("wealth", "date").alias("wealth"), F.stddev_samp("__r").alias("__sd"),
        F.max("__fall").alias("drawdown"), F.sum("turnover").alias("turnover"), F.sum("trades").alias("trades"),
    )
    years = years_between(F.col("first"), F.col("last"))
    return s.withColumn("growth", F.when(years > 0, F.log("wealth") / years)).withColumn("volatility", F.when(years > 0, F.col("__sd") * F.sqrt((F.col("rows") - 1) / years))).drop("__sd")
