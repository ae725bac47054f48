"""Study designs: event studies, expanding refits, annual selection, volatility management, cash, reconciliation of vintages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import discount_growth, displayed
from .models import gram
from .outcomes import numbered
from .windows import as_of, over, series

#: Event-study buckets as (name, lowest, highest) displayed score.
BUCKETS = (("<=15", 0, 15), ("<=25", 0, 25), ("40-60", 40, 60), (">=75", 75, 100), (">=85", 85, 100))


def event_study(rows: DataFrame, keys: list[str], outcomes: dict[int, str]) -> DataFrame:
    """Per bucket of the displayed score and horizon: how many, their mean outcome, its gap to all rows' mean, and the share above zero."""
    shown = rows.withColumn("_s", displayed(F.col("score")))
    long = shown.select(*keys, "_s", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(c).alias("y")) for h, c in outcomes.items()))).alias("o")).select(*keys, "_s", "o.*").filter("y is not null and _s is not null")
    all_ = long.groupBy(*keys, "horizon").agg(F.avg("y").alias("all_mean"))
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, lo, hi in BUCKETS)))
    inside = long.withColumn("_b", named).filter(F.col("_s").between(F.col("_b.lo"), F.col("_b.hi")))
    found = inside.groupBy(*keys, "horizon", F.col("_b.bucket").alias("bucket")).agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.avg((F.col("y") > 0).cast("double")).alias("share_up"))
    return found.join(all_, [*keys, "horizon"]).withColumn("gap", F.col("mean") - F.col("all_mean")).drop("all_mean")


def non_overlapping(rows: DataFrame, keys: list[str]) -> DataFrame:
    """How many outcomes [entry, exit] can be chosen one after another without overlap, first come first served."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        until, n = None, 0
        for entry, exit_ in pdf.sort_values("entry")[["entry", "exit"]].itertuples(index=False):
            if until is None or entry >= until:
                until, n = exit_, n + 1
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "rows": [len(pdf)], "apart": [n]})

    fields = {f.name: f for f in rows.schema.fields}
    return rows.groupBy(*keys).applyInPandas(fold, T.StructType([*(fields[k] for k in keys), T.StructField("rows", T.LongType()), T.StructField("apart", T.LongType())]))


def walk_forward(rows: DataFrame, keys: list[str], features: list[str], label: str, first: int, refit: int = 21, delay: int = 2) -> DataFrame:
    """Forecasts of ordinary least squares refitted every `refit` rows on all rows whose outcome was known by then.

    The sums of each block of rows are accumulated over blocks, so that every row is read once, whatever the number
    of refits; a refit solves one small system. rows: keys, date, features, label."""
    rows = numbered(rows.dropna(subset=features), keys).drop("n")
    block = F.when(F.col("i") >= first, F.floor((F.col("i") - first) / refit)).otherwise(-1).cast("long")
    rows = rows.withColumn("block", block)
    # a row's outcome is known to the blocks that start `delay` rows after it or later
    known = F.when(F.col("i") + delay <= first, 0).otherwise(F.ceil((F.col("i") + delay - first) / refit)).cast("long")
    sums = gram(rows.withColumn("known", known), [*keys, "known"], features, label)
    names = ["1", *features, label]
    pairs = [f"{a}*{b}" for i, a in enumerate(names) for b in names[i:]]
    blocks = rows.filter("block >= 0").select(*keys, F.col("block").alias("known")).distinct()
    upto = Window.partitionBy(*keys).orderBy("known").rangeBetween(Window.unboundedPreceding, 0)
    every = blocks.join(sums, [*keys, "known"], "full").select(*keys, "known", *(F.sum(F.coalesce(F.col(f"`{p}`"), F.lit(0.0))).over(upto).alias(p) for p in pairs))

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf[pairs].to_numpy(float):
                m = np.zeros((len(names),) * 2)
                m[np.triu_indices(len(names))] = row
                m = m + m.T - np.diag(np.diag(m))
                try:
                    out.append(np.linalg.solve(m[:-1, :-1], m[:-1, -1]).tolist())
                except np.linalg.LinAlgError:
                    out.append(None)
            yield pdf[[*keys, "known"]].assign(beta=out)

    fields = {f.name: f for f in rows.schema.fields}
    fitted = every.mapInPandas(solve, T.StructType([*(fields[k] for k in keys), T.StructField("known", T.LongType()), T.StructField("beta", T.ArrayType(T.DoubleType()))]))
    joined = rows.filter("block >= 0").join(fitted.withColumnRenamed("known", "block"), [*keys, "block"])
    forecast = F.get("beta", F.lit(0))
    for i, f in enumerate(features):
        forecast = forecast + F.get("beta", F.lit(i + 1)) * F.col(f)
    return joined.select(*keys, "date", label, "block", forecast.alias("forecast"))


def cash_wealth(calendar: DataFrame, yields: DataFrame, keys: list[str], percent: str, stale: int = 7) -> DataFrame:
    """Wealth of cash on a calendar: every day earns the bill yield last known the day before; days without one earn nothing and are counted."""
    spans = calendar.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = spans.select(*keys, F.explode(F.sequence(F.date_add("first", 1), "last")).alias("day"))
    known = as_of(days.select(*keys, F.date_sub("day", 1).alias("date")), yields.join(spans.select(*keys)), keys, [percent], stale)
    growth = known.select(*keys, F.date_add("date", 1).alias("date"), F.coalesce(F.log(discount_growth(F.col(percent), F.lit(1))), F.lit(0.0)).alias("g"), F.col(percent).isNull().cast("int").alias("dry"))
    upto = over(keys)
    whole = growth.select(*keys, "date", F.exp(F.sum("g").over(upto)).alias("wealth"), F.sum("dry").over(upto).alias("days_without"))
    return calendar.select(*keys, "date").join(whole, [*keys, "date"], "left").fillna({"wealth": 1.0, "days_without": 0})


def banded_schedule(states: DataFrame, keys: list[str], power: Column | float, cap: Column | float, low: float = 0.5, band: float = 0.10) -> DataFrame:
    """Monthly targets min(cap, max(low, ratio^power)), kept as they are while a new one differs by less than the band. states: keys, month, ratio."""
    asked = states.filter("ratio is not null").withColumn("asked", F.least(F.lit(cap), F.greatest(F.lit(low), F.pow("ratio", F.lit(power)))))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        now, out = None, []
        for x in pdf["asked"]:
            if now is None or abs(x - now) >= band - 16 * np.finfo(float).eps:
                now = x
            out.append(now)
        return pdf.assign(target=out)

    return asked.groupBy(*keys).applyInPandas(fold, T.StructType([*asked.schema.fields, T.StructField("target", T.DoubleType())]))


def fragility(scores: DataFrame, keys: list[str], components: list[str], lag: int = 5) -> DataFrame:
    """Dispersion of component scores times their downside weakening over `lag` rows."""
    w = series(keys)
    parts = F.array(*components)
    mean = sum(F.col(c) for c in components) / len(components)
    dispersion = F.sqrt(sum(F.pow(F.col(c) - mean, 2) for c in components) / len(components)) / 100
    falls = F.sqrt(sum(F.pow(F.greatest(F.lit(0.0), F.lag(c, lag).over(w) - F.col(c)), 2) for c in components) / len(components)) / 100
    whole = ~F.exists(parts, lambda x: x.isNull()) & F.lag(components[0], lag).over(w).isNotNull()
    return scores.select(*keys, "date", F.when(whole, dispersion * falls).alias("fragility"))


def month_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Monthly log growth of two curves at their last common dates, and the difference."""
    both = a.select(*keys, "date", F.col("wealth").alias("x")).join(b.select(*keys, "date", F.col("wealth").alias("y")), [*keys, "date"])
    ends = both.groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.max_by("x", "date").alias("x"), F.max_by("y", "date").alias("y"))
    w = Window.partitionBy(*keys).orderBy("month")
    grown = ends.select(*keys, "month", F.log(F.col("x") / F.lag("x").over(w)).alias("gx"), F.log(F.col("y") / F.lag("y").over(w)).alias("gy"))
    return grown.filter("gx is not null").withColumn("difference", F.col("gx") - F.col("gy"))


def rebased(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A new vintage put on the level of the old one at their last common date, and only its rows after the old ones."""
    common = old.select(*keys, "date", F.col("close").alias("o")).join(new.select(*keys, "date", F.col("close").alias("n")), [*keys, "date"]).filter("o > 0 and n > 0")
    factor = common.groupBy(*keys).agg((F.max_by("o", "date") / F.max_by("n", "date")).alias("factor"))
    last = old.groupBy(*keys).agg(F.max("date").alias("last"))
    return new.join(factor, keys).join(last, keys).filter("date > last").select(*keys, "date", (F.col("close") * F.col("factor")).alias("close"))


def windows_against(rows: DataFrame, values: DataFrame, keys: list[str], start: str, end: str, value: str) -> DataFrame:
    """The growth of a value between two dates of each row, with the reason why it can't be told."""
    at = lambda name, day: values.select(*keys, F.col("date").alias(day), F.col(value).alias(name))
    both = rows.join(at("_a", start), [*keys, start], "left").join(at("_b", end), [*keys, end], "left")
    reason = F.when(F.col("_a").isNull(), "no value at start").when(F.col("_b").isNull(), "no value at end")
    return both.withColumn("growth", F.col("_b") / F.col("_a") - 1).withColumn("reason", reason).drop("_a", "_b")


def error_summary(rows: DataFrame, keys: list[str], error: Column) -> DataFrame:
    """Errors in basis points: mean, mean absolute, root mean square, quantiles of the absolute one."""
    e = rows.withColumn("_e", error * 10_000).filter("_e is not null")
    q = F.percentile(F.abs("_e"), F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    return e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_e").alias("mean"), F.avg(F.abs("_e")).alias("mae"), F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse"), q.alias("q"), F.max(F.abs("_e")).alias("worst")).select(*keys, "n", "mean", "mae", "rmse", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p90"), F.get("q", F.lit(2)).alias("p99"), "worst")


def upserted(saved: DataFrame, live: DataFrame, keys: list[str], digest: str, modified: str) -> DataFrame:
    """A table after an upload: equal digests change nothing, an older modification time doesn't replace a newer one; `revision` counts what a key has been replaced."""
    new = live.select(*keys, *(F.col(c).alias(f"_{c}") for c in live.columns if c not in keys))
    both = saved.join(new, keys, "full")
    fresh = F.col(digest).isNull() | (F.col(f"_{digest}").isNotNull() & (F.col(f"_{digest}") != F.col(digest)) & (F.col(f"_{modified}") >= F.col(modified)))
    take = lambda c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*keys, *(take(c) for c in live.columns if c not in keys), F.when(F.col(digest).isNull(), 0).when(fresh, F.col("revision") + 1).otherwise(F.col("revision")).alias("revision"))


def expected_days(known: DataFrame, upto: str, keys: list[str]) -> DataFrame:
    """Weekdays after each key's last known day up to a date: what an incremental fill has to ask for."""
    last = known.groupBy(*keys).agg(F.max("date").alias("last"))
    days = last.select(*keys, F.explode(F.sequence(F.date_add("last", 1), F.greatest(F.date_add("last", 1), F.lit(upto).cast("date")))).alias("date"))
    return days.filter(~F.dayofweek("date").isin(1, 7) & (F.col("date") <= F.lit(upto).cast("date")))


def gates(metrics: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """One column per rule, how many pass, the names of those that fail, and whether all pass."""
    out = metrics.select(*keys, *(F.coalesce(c, F.lit(False)).alias(n) for n, c in rules.items()))
    failed = F.array_compact(F.array(*(F.when(~F.col(n), n) for n in rules)))
    return out.withColumn("passed", sum(F.col(n).cast("int") for n in rules)).withColumn("failed", F.array_join(failed, ",")).withColumn("all_pass", F.size(failed) == 0)


def annual_winners(results: DataFrame, keys: list[str], year: str, score: str, order: list[str]) -> DataFrame:
    """Each year's candidate with the best mean score over keys in the three years before it; ties by declaration."""
    lagged = results.withColumn("_y", F.explode(F.sequence(F.col(year) + 1, F.col(year) + 3)))
    trained = lagged.groupBy(F.col("_y").alias(year), *order).agg(F.avg(score).alias("mean"), F.countDistinct(year).alias("years")).filter("years = 3")
    best = F.row_number().over(Window.partitionBy(year).orderBy(F.desc("mean"), *order))
    return trained.withColumn("_k", best).filter("_k = 1").drop("_k", "years")
