"""Statistics by group: summaries, ranks, regressions, tests for autocorrelated series, multiplicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import band, half_up, normal_cdf
from .windows import series


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    x = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var_samp"), F.var_pop(x).alias("var_pop"), F.stddev_samp(x).alias("sd_samp"), F.stddev_pop(x).alias("sd_pop"),
        F.median(x).alias("median"), F.percentile(x, F.lit(0.05)).alias("q05"), F.percentile(x, F.lit(0.95)).alias("q95"), F.min(x).alias("low"), F.max(x).alias("high"),
    )


def average_rank(value: str, keys: list[str]) -> Column:
    """Ranks in which ties share their mean."""
    by = Window.partitionBy(*keys).orderBy(value)
    return F.rank().over(by) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def correlations(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation; null with fewer than three pairs."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = both.withColumn("rx", average_rank(x, keys)).withColumn("ry", average_rank(y, keys))
    enough = lambda c: F.when(F.count("*") >= 3, c)
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), enough(F.corr(x, y)).alias("pearson"), enough(F.corr("rx", "ry")).alias("spearman"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def lagged(rows: DataFrame, keys: list[str], columns: list[str], bandwidth: Column) -> DataFrame:
    """Each row with each of its predecessors up to `bandwidth` rows back: `lag`, and the columns of the
    predecessor with the suffix _lag. rows have `i`, their number within the key."""
    ahead = rows.select(*keys, *(F.col(c).alias(f"{c}_lag") for c in columns), F.col("i").alias("i0"), F.explode(F.sequence(F.lit(1), bandwidth)).alias("lag"))
    return rows.join(ahead.withColumn("i", F.col("i0") + F.col("lag")), [*keys, "i"])


def automatic_bandwidth(n: Column) -> Column:
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))


def newey_west_slope(df: DataFrame, keys: list[str], score: str, outcome: str, horizon: Column | int) -> DataFrame:
    """The slope of an outcome per ten points of score, with a Bartlett-weighted covariance and a two-sided test."""
    per = Window.partitionBy(*keys)
    x, y = (F.col(score) - 50) / 10, F.col(outcome)
    rows = df.filter(F.col(score).isNotNull() & y.isNotNull()).select(*keys, "date", x.alias("x"), y.alias("y"))
    rows = rows.withColumn("i", F.row_number().over(series(keys))).withColumn("n", F.count("*").over(per))
    rows = rows.withColumn("b", F.regr_slope("y", "x").over(per)).withColumn("a", F.avg("y").over(per) - F.col("b") * F.avg("x").over(per))
    rows = rows.withColumn("e", F.col("y") - F.col("a") - F.col("b") * F.col("x")).withColumn("ex", F.col("e") * F.col("x"))
    bandwidth = F.least(F.col("n") - 3, F.greatest(F.lit(horizon), automatic_bandwidth(F.col("n")))).cast("int")
    rows = rows.filter("n >= 8").withColumn("bw", bandwidth)
    now = rows.groupBy(*keys, "n", "b", "a", "bw").agg(F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("e") * F.col("e")).alias("m00"), F.sum(F.col("e") * F.col("ex")).alias("m01"), F.sum(F.col("ex") * F.col("ex")).alias("m11"))
    w = 1 - F.col("lag") / (F.col("bw") + 1)
    back = lagged(rows, keys, ["e", "ex"], F.col("bw")).groupBy(*keys).agg(
        F.sum(w * 2 * F.col("e") * F.col("e_lag")).alias("l00"), F.sum(w * (F.col("e") * F.col("ex_lag") + F.col("e_lag") * F.col("ex"))).alias("l01"), F.sum(w * 2 * F.col("ex") * F.col("ex_lag")).alias("l11")
    )
    det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    p, q = -F.col("sx") / det, F.col("n") / det
    variance = (p * p * (F.col("m00") + F.col("l00")) + 2 * p * q * (F.col("m01") + F.col("l01")) + q * q * (F.col("m11") + F.col("l11"))) * F.col("n") / (F.col("n") - 2)
    z = F.col("b") / F.col("se")
    return (
        now.join(back, keys).withColumn("se", F.sqrt(F.greatest(variance, F.lit(0.0))))
        .select(*keys, "n", F.col("bw").alias("bandwidth"), F.col("b").alias("slope"), "se", z.alias("z"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z))))).alias("p"))
    )


def newey_west_mean(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """The mean with a Bartlett-weighted standard error and the one-sided p of a positive mean."""
    per = Window.partitionBy(*keys)
    rows = df.filter(F.col(value).isNotNull()).select(*keys, "date", F.col(value).alias("v"))
    rows = rows.withColumn("i", F.row_number().over(series(keys))).withColumn("n", F.count("*").over(per)).withColumn("m", F.avg("v").over(per)).withColumn("c", F.col("v") - F.col("m"))
    rows = rows.filter(F.col("n") >= least + 2).withColumn("bw", F.least(F.col("n") - 1, F.greatest(F.lit(least), automatic_bandwidth(F.col("n")))).cast("int"))
    now = rows.groupBy(*keys, "n", "m", "bw").agg(F.sum(F.col("c") * F.col("c")).alias("g0"))
    w = 2 * (1 - F.col("lag") / (F.col("bw") + 1))
    back = lagged(rows, keys, ["c"], F.col("bw")).groupBy(*keys).agg(F.sum(w * F.col("c") * F.col("c_lag")).alias("g"))
    se = F.sqrt(F.greatest(F.lit(0.0), (F.col("g0") + F.col("g")) / F.col("n")) / F.col("n"))
    z = F.col("m") / F.col("se")
    p = F.when(F.col("se") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - normal_cdf(z)))).otherwise(F.when(F.col("m") > 0, 0.0).otherwise(1.0))
    return now.join(back, keys).withColumn("se", se).select(*keys, "n", F.col("bw").alias("bandwidth"), F.col("m").alias("mean"), "se", p.alias("p"))


def benjamini_hochberg(tests: DataFrame, p: str, keys: list[str], order: list[str], level: float = 0.05) -> DataFrame:
    """tests with `q` (adjusted, monotone) and `rejected` at the level. keys name families; order breaks ties."""
    family = Window.partitionBy(*keys)
    up, down = family.orderBy(p, *order), family.orderBy(F.desc(p), *(F.desc(o) for o in order))
    m = F.count("*").over(family)
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_m", m)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(F.col(p) <= F.col("_rank") / F.col("_m") * level, F.col("_rank"))).over(family)
    return ranked.withColumn("q", q).withColumn("rejected", F.coalesce(F.col("_rank") <= last, F.lit(False))).drop("_rank", "_m")


def holm(tests: DataFrame, p: str, keys: list[str], order: list[str], level: float = 0.05) -> DataFrame:
    """tests with `holm_p` (running maximum) and `holm_rejected` (step-down until the first failure)."""
    family = Window.partitionBy(*keys)
    up = family.orderBy(p, *order)
    left = F.count("*").over(family) - F.row_number().over(up) + 1
    ranked = tests.withColumn("_left", left)
    upto = up.rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("holm_p", F.least(F.lit(1.0), F.max(F.col(p) * F.col("_left")).over(upto))).withColumn("holm_rejected", F.min(F.col(p) <= level / F.col("_left")).over(upto)).drop("_left")


def agreement(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """How two score series agree on their common dates."""
    gap = F.col(a) - F.col(b)
    bands = F.abs(band(half_up(F.col(a), 1)) - band(half_up(F.col(b), 1)))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr(a, b)).alias("correlation"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mean_abs_gap"),
        (100 * F.avg((bands == 0).cast("double"))).alias("same_band"), (100 * F.avg((bands <= 1).cast("double"))).alias("within_one_band"),
    )


def share_below_latest(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last value, and the share (percent) of all values strictly below it."""
    last = df.groupBy(*keys).agg(F.max_by(value, "date").alias("latest"))
    return df.join(last, keys).groupBy(*keys, "latest").agg((100 * F.avg((F.col(value) < F.col("latest")).cast("double"))).alias("share_below"), F.count("*").alias("n"))


def by_band(df: DataFrame, keys: list[str], score: str, outcome: str) -> DataFrame:
    """Count, mean and median outcome of each score band, bands without rows included."""
    from ..functions.numbers import LABELS, label

    every = df.select(*keys).distinct().withColumn("label", F.explode(F.array(*map(F.lit, LABELS))))
    have = df.withColumn("label", label(F.col(score))).groupBy(*keys, "label").agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.median(outcome).alias("median"))
    return every.join(have, [*keys, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tails(train: DataFrame, test: DataFrame, keys: list[str], score: str, outcome: str) -> DataFrame:
    """Mean test outcomes below the first and above the third quartile of training scores."""
    cuts = train.groupBy(*keys).agg(F.percentile(score, F.lit(0.25)).alias("low_cut"), F.percentile(score, F.lit(0.75)).alias("high_cut"))
    low, high = F.col(score) <= F.col("low_cut"), F.col(score) >= F.col("high_cut")
    return test.join(cuts, keys).groupBy(*keys, "low_cut", "high_cut").agg(
        F.count(F.when(low, 1)).alias("n_low"), F.avg(F.when(low, F.col(outcome))).alias("mean_low"), F.count(F.when(high, 1)).alias("n_high"), F.avg(F.when(high, F.col(outcome))).alias("mean_high")
    )


def episodes(df: DataFrame, keys: list[str], index: str, where: Column) -> DataFrame:
    """Runs of consecutive indices that satisfy a condition: how many, their mean and greatest length."""
    hit = df.filter(where).withColumn("_run", F.col(index) - F.row_number().over(Window.partitionBy(*keys).orderBy(index)))
    runs = hit.groupBy(*keys, "_run").agg(F.count("*").alias("length"))
    return runs.groupBy(*keys).agg(F.count("*").alias("episodes"), F.avg("length").alias("mean_length"), F.max("length").alias("longest"))


def performance(curve: DataFrame, keys: list[str], r: str, per_year: int = 252) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio and the greatest drawdown (from a peak of at least 1) of simple returns."""
    upto = series(keys).rowsBetween(Window.unboundedPreceding, 0)
    wealth = curve.filter(F.col(r).isNotNull()).withColumn("_w", F.exp(F.sum(F.log1p(r)).over(upto)))
    fallen = wealth.withColumn("_d", F.col("_w") / F.greatest(F.lit(1.0), F.max("_w").over(upto)) - 1)
    grown = F.exp(F.sum(F.log1p(r)))
    return fallen.groupBy(*keys).agg(
        F.count("*").alias("n"), (grown - 1).alias("total_return"), (F.pow(grown, per_year / F.count("*")) - 1).alias("annual_return"), (F.stddev_samp(r) * per_year**0.5).alias("volatility"),
        (F.avg(r) / F.stddev_samp(r) * per_year**0.5).alias("sharpe"), F.min("_d").alias("max_drawdown"),
    )


def forecast_comparison(df: DataFrame, keys: list[str], outcome: str, base: str, model: str, lag: int = 5) -> DataFrame:
    """Mean squared errors, the model's relative gain, and the Clark-West test of the nested models."""
    e0, e1 = F.col(outcome) - F.col(base), F.col(outcome) - F.col(model)
    gap = F.col(base) - F.col(model)
    rows = df.withColumn("_loss", e0 * e0 - e1 * e1 + gap * gap)
    mse = rows.groupBy(*keys).agg(F.avg(e0 * e0).alias("mse_base"), F.avg(e1 * e1).alias("mse_model"))
    test = newey_west_mean(rows, keys, "_loss", lag).select(*keys, F.col("mean").alias("adjusted_loss"), F.col("p").alias("clark_west_p"))
    return mse.withColumn("gain", 100 * (1 - F.col("mse_model") / F.col("mse_base"))).join(test, keys)


def weighted_moments(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean and (population) scale."""
    total = F.sum(weight)
    mean = F.sum(F.col(weight) * F.col(value)) / total
    square = F.sum(F.col(weight) * F.col(value) * F.col(value)) / total
    return df.agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("scale"))
