"""Features known at a close and outcomes after it; splits; month ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import full_mean, log_return, over, series

HORIZONS = (1, 5, 21, 63)


def forward_returns(bars: DataFrame, keys: list[str], horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Returns from the next close on: decided at t, entered at t + 1, left at t + 1 + h."""
    w = series(keys)
    return bars.select(*keys, "date", *((F.lead("close", 1 + h).over(w) / F.lead("close", 1).over(w) - 1).alias(f"fwd_{h}") for h in horizons), F.log(F.lead("close", 2).over(w) / F.lead("close", 1).over(w)).alias("label"))


def future_log_vol(bars: DataFrame, keys: list[str], n: int = 21) -> DataFrame:
    """The log of the sample deviation of the n log returns after the next close."""
    w = series(keys).rowsBetween(2, n + 1)
    r = bars.withColumn("r", log_return(F.col("close"), keys))
    return r.select(*keys, "date", F.when(F.count("r").over(w) == n, F.log(F.stddev_samp("r").over(w))).alias("log_vol"))


def forward_drawdown(bars: DataFrame, keys: list[str], n: int = 21) -> DataFrame:
    """The greatest fall, in logs and positive, of the path from t + 1 to t + 1 + n, scaled by the 20-bar deviation."""
    path = F.collect_list("close").over(series(keys).rowsBetween(1, n + 1))
    back = over(keys, 19)
    rows = bars.withColumn("r", log_return(F.col("close"), keys)).withColumn("sd", F.when(F.count("r").over(back) == 20, F.stddev_samp("r").over(back))).withColumn("path", path)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("fall"))
    step = lambda s, c: F.struct(F.greatest(s["peak"], c).alias("peak"), F.greatest(s["fall"], F.log(F.greatest(s["peak"], c) / c)).alias("fall"))
    fall = F.when(F.size("path") == n + 1, F.aggregate("path", start, step, lambda s: s["fall"]))
    return rows.select(*keys, "date", fall.alias("drawdown"), F.log1p(fall / (F.col("sd") * n**0.5)).alias("outcome"))


def controls(bars: DataFrame, keys: list[str], per_year: int = 252) -> DataFrame:
    """Simple returns over 1, 5 and 20 bars, volatility of 20 and distance from the 125-bar mean, from bar 126 on."""
    w, back = series(keys), over(keys, 19)
    rows = bars.withColumn("r", F.col("close") / F.lag("close").over(w) - 1).withColumn("i", F.row_number().over(w))
    change = lambda k: (F.col("close") / F.lag("close", k).over(w) - 1).alias(f"r{k}")
    out = rows.select(*keys, "date", "i", change(1), change(5), change(20), (F.stddev_samp("r").over(back) * per_year**0.5).alias("vol20"), (F.col("close") / full_mean(F.col("close"), keys, 125) - 1).alias("trend125"))
    return out.filter("i > 125").drop("i")


def learner_features(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Price features and, from `score`, its centre, square, changes and interaction with trend; with the list of
    reasons why a row can't be used. rows: keys, date, close, score."""
    w, back = series(keys), over(keys, 19)
    r = rows.withColumn("r", log_return(F.col("close"), keys))
    lag = lambda k: log_return(F.col("close"), keys, k).alias(f"log{k}")
    delta = lambda k: (F.col("score") - F.lag("score", k).over(w)).alias(f"d{k}")
    out = r.select(*keys, "date", "score", lag(1), lag(5), lag(20), F.when(F.count("r").over(back) == 20, F.stddev_pop("r").over(back)).alias("vol20"), F.log(F.col("close") / full_mean(F.col("close"), keys, 125)).alias("trend"), (F.col("score") - 50).alias("centre"), F.pow(F.col("score") - 50, 2).alias("square"), delta(1), delta(5), delta(21))
    out = out.withColumn("interaction", F.col("centre") * F.col("trend"))
    reasons = F.array_compact(F.array(F.when(F.col("score").isNull(), "no score"), F.when(F.col("log20").isNull(), "short history"), F.when(F.col("trend").isNull(), "no trend"), F.when(F.col("d21").isNull(), "no score change")))
    return out.withColumn("reasons", F.array_join(reasons, ","))


def state_vector(bars: DataFrame, keys: list[str]) -> DataFrame:
    """Distances from means of 100 and 200 bars, volatilities of 20, 63 and 252, drawdown from the 252-bar high, and the bounded scores made of them."""
    r = bars.withColumn("r", log_return(F.col("close"), keys))
    c = F.col("close")
    vol = lambda n: F.when(F.count("r").over(over(keys, n - 1)) == n, F.stddev_samp("r").over(over(keys, n - 1)))
    top = over(keys, 251)
    rows = r.select(*keys, "date", F.log(c / full_mean(c, keys, 100)).alias("sma100"), F.log(c / full_mean(c, keys, 200)).alias("sma200"), vol(20).alias("vol20"), vol(63).alias("vol63"), vol(252).alias("vol252"), F.when(F.count("close").over(top) == 252, F.log(c / F.max("close").over(top))).alias("drawdown"))
    clip = lambda x: F.when(x.isNotNull(), F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)))
    z = lambda x: x / (F.col("vol63") * 20**0.5)
    return rows.select(
        *keys, "date", "sma100", "sma200", "vol20", "vol63", "drawdown",
        clip(50 + 25 * z(F.col("sma200"))).alias("trend_score"), clip(100 + 50 * z(F.col("drawdown"))).alias("strength_score"), clip(50 - 50 * F.log2(F.col("vol20") / F.col("vol252"))).alias("volatility_score"),
    )


def month_ends(bars: DataFrame, keys: list[str]) -> DataFrame:
    """The last bar of each calendar month."""
    month = F.trunc("date", "month")
    last = F.row_number().over(Window.partitionBy(*keys, month).orderBy(F.desc("date")))
    return bars.withColumn("_k", last).filter("_k = 1").drop("_k")


def month_mean_orders(bars: DataFrame, keys: list[str], months: int = 10) -> DataFrame:
    """At each month end: in if the close is above the mean of the last month ends. Carried out at the next close; the last one isn't."""
    ends = month_ends(bars, keys).withColumn("mean", full_mean(F.col("close"), keys, months))
    follow = bars.withColumn("execution", F.lead("date").over(series(keys))).select(*keys, "date", "execution")
    return ends.filter("mean is not null").join(follow, [*keys, "date"]).filter("execution is not null").select(*keys, "date", "execution", "mean", (F.col("close") > F.col("mean")).cast("int").alias("target"))


def trailing_year_reference(bars: DataFrame, keys: list[str], days: int = 365, stale: int = 7) -> DataFrame:
    """For each bar the last close at or before a year ago, at most a week older."""
    from .windows import as_of

    asked = bars.select(*keys, F.date_sub("date", days).alias("date"))
    ref = as_of(asked, bars, keys, ["close"], stale).select(*keys, F.date_add("date", days).alias("date"), F.col("close").alias("reference"), F.col("as_of").alias("reference_date"))
    return bars.join(ref, [*keys, "date"], "left")


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """With `i` (from 0) and `n`."""
    return df.withColumn("i", F.row_number().over(series(keys)) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*keys)))


def split(df: DataFrame, keys: list[str], shares: tuple[float, ...], names: tuple[str, ...]) -> DataFrame:
    """Rows in order cut at the given cumulative shares of each series: `part`."""
    part: Column = F.lit(names[-1])
    for share, name in reversed(list(zip(shares, names))):
        part = F.when(F.col("i") < F.floor(F.col("n") * share), name).otherwise(part)
    return numbered(df, keys).withColumn("part", part).drop("i", "n")


def purged_split(observations: DataFrame, keys: list[str], share: float = 0.6) -> DataFrame:
    """Train and test rows; training rows whose outcome is not known by the first test entry go. observations: date, entry, exit."""
    parts = split(observations, keys, (share,), ("train", "test"))
    first = F.min(F.when(F.col("part") == "test", F.col("entry"))).over(Window.partitionBy(*keys))
    return parts.withColumn("_first", first).filter((F.col("part") == "test") | (F.col("exit") <= F.col("_first"))).drop("_first")


def rotated(df: DataFrame, keys: list[str], value: str, offset: Column) -> DataFrame:
    """The values of a series moved round by an offset on its own calendar. df may hold `offset`'s columns as keys."""
    rows = numbered(df, keys)
    moved = rows.select(*keys, F.pmod(F.col("i") + offset, F.col("n")).alias("i"), F.col(value).alias(f"{value}_rotated"))
    return rows.join(moved, [*keys, "i"]).drop("i", "n")


def monthly_variance(excess: DataFrame, keys: list[str], least: int = 15, anchor: int = 12) -> DataFrame:
    """Mean squared return of each month with enough returns, and the median of the `anchor` months before it, if all are there, over it. excess: keys, date, r."""
    months = excess.filter("r is not null").groupBy(*keys, F.trunc("date", "month").alias("month")).agg(F.avg(F.col("r") * F.col("r")).alias("variance"), F.count("*").alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy(*keys).orderBy(F.months_between("month", F.lit("1970-01-01").cast("date")).cast("int")).rangeBetween(-anchor, -1)
    whole = F.count("*").over(w) == anchor
    return months.withColumn("before", F.when(whole, F.sort_array(F.collect_list("variance").over(w)))).select(*keys, "month", "variance", "n", ((F.get("before", F.lit(anchor // 2 - 1)) + F.get("before", F.lit(anchor // 2))) / 2 / F.col("variance")).alias("ratio"))
