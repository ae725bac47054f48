"""Windows over series. A series is a key (one or more columns) and a date; frames count observations."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def over(keys: list[str], before: int | None = None, after: int = 0, order: str = "date") -> WindowSpec:
    """Rows of the same series in order, from `before` rows back (None: all) to `after` rows ahead."""
    w = Window.partitionBy(*keys).orderBy(order)
    return w if before == 0 and after == 0 else w.rowsBetween(Window.unboundedPreceding if before is None else -before, after)


def series(keys: list[str], order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def full_mean(x: Column, keys: list[str], n: int) -> Column:
    """The mean of n observations; null until there are n."""
    w = over(keys, n - 1)
    return F.when(F.count(x).over(w) == n, F.avg(x).over(w))


def mean_of_available(df: DataFrame, value: str, keys: list[str], n: int, name: str) -> DataFrame:
    """The mean of the last n non-null values, on the rows that have one; null on others."""
    have = df.filter(F.col(value).isNotNull()).withColumn(name, full_mean(F.col(value), keys, n))
    return df.join(have.select(*keys, "date", name), [*keys, "date"], "left")


def momentum(bars: DataFrame, keys: list[str], n: int = 125) -> DataFrame:
    return bars.select(*keys, "date", (100 * (F.col("close") / full_mean(F.col("close"), keys, n) - 1)).alias("raw"))


def strength(bars: DataFrame, keys: list[str], n: int = 252, least: int = 126) -> DataFrame:
    """Distance from the high of at most n bars, from `least` bars on."""
    w = over(keys, n - 1)
    top = F.when(F.count("close").over(w) >= least, F.max("close").over(w))
    return bars.select(*keys, "date", (100 * (F.col("close") / top - 1)).alias("raw"))


def log_return(x: Column, keys: list[str], lag: int = 1) -> Column:
    return F.log(x / F.lag(x, lag).over(series(keys)))


def realised_vol(bars: DataFrame, keys: list[str], n: int = 20, per_year: int = 252) -> DataFrame:
    """Sample deviation of n log returns, annualised, in percent."""
    w = over(keys, n - 1)
    r = bars.withColumn("r", log_return(F.col("close"), keys))
    return r.select(*keys, "date", F.when(F.count("r").over(w) == n, F.stddev_samp("r").over(w) * (per_year**0.5) * 100).alias("raw"))


def relative_to_mean(values: DataFrame, keys: list[str], n: int = 50, share: float = 0.8) -> DataFrame:
    """Distance of `raw` from its own mean over n rows of which at least a share has values."""
    w = over(keys, n - 1)
    ok = (F.count("raw").over(w) >= share * n) & (F.row_number().over(series(keys)) >= n)
    return values.select(*keys, "date", F.when(ok, 100 * (F.col("raw") / F.avg("raw").over(w) - 1)).alias("raw"))


def pair(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """x and y of two series on their common dates."""
    return a.withColumnRenamed("close", "x").join(b.withColumnRenamed("close", "y"), [*keys, "date"])


def return_gap(a: DataFrame, b: DataFrame, keys: list[str], lag: int = 20) -> DataFrame:
    """The difference of two series' returns over `lag` common observations, in percent."""
    change = lambda c: F.col(c) / F.lag(c, lag).over(series(keys)) - 1
    return pair(a, b, keys).select(*keys, "date", (100 * (change("x") - change("y"))).alias("raw"))


def ratio_vs_mean(a: DataFrame, b: DataFrame, keys: list[str], n: int) -> DataFrame:
    ratio = pair(a, b, keys).withColumn("q", F.col("x") / F.col("y"))
    return ratio.select(*keys, "date", (100 * (F.col("q") / full_mean(F.col("q"), keys, n) - 1)).alias("raw"))


def expanding_midrank(values: DataFrame, keys: list[str], least: int = 126) -> DataFrame:
    """`score`: the share (percent) of all values so far below `raw`, equal ones counting half, its own included.

    Each series is kept sorted as it grows, so that n values take n log n steps; a series is one group."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        seen: list[float] = []
        out = []
        for x in pdf["raw"]:
            if pd.isna(x):
                out.append(None)
                continue
            insort(seen, x)
            low, high = bisect_left(seen, x), bisect_right(seen, x)
            out.append(100 * (low + 0.5 * (high - low)) / len(seen) if len(seen) >= least else None)
        return pdf.assign(score=pd.Series(out, index=pdf.index, dtype="float64"))

    rows = values.select(*keys, "date", "raw")
    return rows.groupBy(*keys).applyInPandas(score, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).withColumn("score", F.nullif(F.col("score"), F.lit(float("nan"))))


def trailing_midrank(values: DataFrame, keys: list[str], n: int = 252, least: int = 126) -> DataFrame:
    """The same over the last n rows."""
    seen = F.collect_list("raw").over(over(keys, n - 1))
    below = F.size(F.filter("seen", lambda v: v < F.col("raw")))
    equal = F.size(F.filter("seen", lambda v: v == F.col("raw")))
    score = F.when(F.col("raw").isNotNull() & (F.size("seen") >= least), 100.0 * (below + 0.5 * equal) / F.size("seen"))
    return values.withColumn("seen", seen).select(*keys, "date", "raw", score.alias("score"))


def as_of(calendar: DataFrame, values: DataFrame, keys: list[str], columns: list[str], days: int = 7, extra: tuple[str, ...] = ()) -> DataFrame:
    """For each calendar row the latest values at or before its date, at most `days` calendar days old.

    calendar: keys (without `extra`) and date; values: keys, extra, date and columns. One row per calendar row and
    combination of `extra` in values. Both sides are sorted together and each row looks back over a range of days,
    so a series is read once and no row is joined with more than one other."""
    own = [*keys, *extra]
    spread = calendar.select(*keys, "date").distinct()
    if extra:
        spread = spread.join(values.select(*own).distinct(), keys)
    found = values.select(*own, "date", F.struct(*columns, F.col("date").alias("as_of")).alias("v"))
    every = found.withColumn("c", F.lit(False)).unionByName(spread.withColumn("c", F.lit(True)), allowMissingColumns=True)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    last = F.last("v", ignorenulls=True).over(Window.partitionBy(*own).orderBy(day).rangeBetween(-days, 0))
    return every.withColumn("v", last).filter("c").select(*own, "date", *(F.col(f"v.{c}").alias(c) for c in [*columns, "as_of"]))


def equal_weight_index(bars: DataFrame, keys: list[str], member: str, level: float = 100.0) -> DataFrame:
    """A daily rebalanced index of the members on the dates that all have: `level` times the product of mean growth."""
    n_members = bars.groupBy(*keys).agg(F.countDistinct(member).alias("m"))
    common = bars.groupBy(*keys, "date").agg(F.count_distinct(member).alias("n")).join(n_members, keys).filter("n = m").select(*keys, "date")
    growth = bars.join(common, [*keys, "date"]).withColumn("g", F.col("close") / F.lag("close").over(series([*keys, member])))
    daily = growth.groupBy(*keys, "date").agg(F.avg("g").alias("g"))
    return daily.select(*keys, "date", (level * F.exp(F.sum(F.coalesce(F.log("g"), F.lit(0.0))).over(over(keys)))).alias("close"))
