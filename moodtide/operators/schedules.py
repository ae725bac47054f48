"""Trading schedules: controls that trade on a schedule's days, and cash whose rate changes within an interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import DAYS_PER_YEAR, discount_growth
from .windows import over, series


def executions(schedule: DataFrame, bars: DataFrame, keys: list[str], series_keys: list[str]) -> DataFrame:
    """keys, date, target: the days on which a schedule trades, the first bar of the month after one whose target differs from the last. schedule: keys, month, target; bars: series_keys, date."""
    first = bars.groupBy(*series_keys, F.trunc("date", "month").alias("month")).agg(F.min("date").alias("date")).withColumn("month", F.add_months("month", -1))
    before = F.lag("target").over(Window.partitionBy(*keys).orderBy("month"))
    # a month without a next bar trades nothing, and its target is compared all the same
    return schedule.withColumn("_b", before).filter("_b is null or _b <> target").join(first, [*series_keys, "month"]).select(*keys, "date", "target")


def signatures(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys with `signature`, a digest of the schedule's days in their order, whatever its targets. A schedule has at most an event per bar."""
    days = F.array_join(F.transform(F.array_sort(F.collect_list("date")), lambda d: d.cast("string")), "|")
    return events.groupBy(*keys).agg(F.sha2(days, 256).alias("signature"), F.count("*").alias("events"))


def path(rows: DataFrame, keys: list[str], cost: float, spread: float) -> DataFrame:
    """Log growth `g` of wealth between closes for a schedule of exposures: `target` is the exposure taken at a bar's close (null: nothing is traded), from each series' first row on.

    Between trades the risky amount follows the price and the rest earns cash, or pays `spread` a year more if it is borrowed, so wealth since the last trade is
    exposure * price + (1 - exposure) * cash, each against its value then: no step depends on the state of the one before. A trade costs a share of the amount traded, out of the wealth that the
    new exposure refers to. After the last bar's trade all is sold. rows: keys, date, close, cash (wealth of cash), target. `solvent` is false from the bar on at which wealth is gone."""
    w, upto = series(keys), over(keys)
    carried = lambda c: F.last(F.when(F.col("target").isNotNull(), F.col(c)), ignorenulls=True).over(upto)
    lent = F.col("cash") * F.exp(spread * F.datediff("date", F.lit("1970-01-01").cast("date")) / DAYS_PER_YEAR)
    x = rows.withColumn("_k", lent).select("*", carried("target").alias("_x"), carried("close").alias("_p"), carried("cash").alias("_c"), carried("_k").alias("_l"))
    x = x.select("*", *(F.lag(c).over(w).alias(f"{c}1") for c in ("_x", "_p", "_c", "_l", "close", "cash", "_k")), F.lead("date").over(w).isNull().alias("_last"))
    idle = lambda cash, owed: (1 - F.col("_x1")) * F.when(F.col("_x1") > 1, F.col(owed) / F.col("_l1")).otherwise(F.col(cash) / F.col("_c1"))
    risky = F.col("_x1") * F.col("close") / F.col("_p1")
    x = x.withColumn("_now", risky + idle("cash", "_k")).withColumn("_then", F.col("_x1") * F.col("close1") / F.col("_p1") + idle("cash1", "_k1")).withColumn("_r", risky / F.col("_now"))
    t = F.col("target")
    traded = F.when(t > F.col("_r"), (1 + cost * F.col("_r")) / (1 + cost * t)).when(t < F.col("_r"), (1 - cost * F.col("_r")) / (1 - cost * t)).otherwise(1.0)
    sold = F.when(F.col("_last"), 1 - cost * F.coalesce(t, F.col("_r"))).otherwise(1.0)
    alive = F.min(F.coalesce(F.col("_now") > 0, F.lit(True)).cast("int")).over(upto) == 1
    x = x.withColumn("solvent", alive).withColumn("g", F.when(F.col("_now") > 0, F.log(F.col("_now") / F.col("_then") * traded * sold)))
    return x.drop(*(c for c in x.columns if c.startswith("_")), "close1", "cash1")


def volatility(paths: DataFrame, keys: list[str]) -> DataFrame:
    """keys, volatility a year and wealth of paths that stay solvent."""
    years = F.datediff(F.max("date"), F.min("date")) / DAYS_PER_YEAR
    found = paths.groupBy(*keys).agg((F.stddev_samp("g") * F.sqrt(F.count("g") / years)).alias("volatility"), F.exp(F.sum("g")).alias("wealth"), F.min(F.col("solvent").cast("int")).alias("_ok"))
    return found.filter("_ok = 1").drop("_ok")


def matched_controls(events: DataFrame, bars: DataFrame, keys: list[str], series_keys: list[str], targets: Column, cost: float, spread: float) -> DataFrame:
    """For each schedule the constant exposure of a grid whose volatility is nearest to its own when it is restored on the same days; ties to the lower.

    Schedules with the same days have the same controls: each distinct signature of a series meets the grid once, and its results go back to
    all its schedules. keys, events, sharing (schedules of that signature), simulations (paths made for it), own, target, control, gap. events: keys, date, target; bars: series_keys, date, close, cash."""
    marks = signatures(events, keys)
    groups = marks.groupBy(*series_keys, "signature").agg(F.count("*").alias("sharing"), F.min_by(F.struct(*keys), F.struct(*keys)).alias("_one"))
    # the days of a group are those of one of its schedules
    one = groups.select("signature", *(F.col(f"_one.{k}").alias(k) for k in keys))
    days = events.join(one, keys).select(*series_keys, "signature", "date", F.lit(True).alias("_day"))
    own = volatility(path(_from_first(bars, events, keys, series_keys), keys, cost, spread), keys)
    group = [*series_keys, "signature"]
    grid = _from_first(bars, days.withColumn("target", F.lit(0.0)), group, series_keys).withColumn("grid", F.explode(targets)).withColumn("target", F.when(F.col("target").isNotNull(), F.col("grid")))
    tried = volatility(path(grid, [*group, "grid"], cost, spread), [*group, "grid"])
    made = tried.groupBy(*group).agg(F.count("*").alias("simulations"))
    both = marks.join(own.select(*keys, F.col("volatility").alias("own")), keys).join(tried.select(*group, "grid", F.col("volatility").alias("control")), group)
    gap = F.round(F.abs(F.col("control") - F.col("own")), 10)
    best = both.groupBy(*keys, "signature", "events", "own").agg(F.min(F.struct(gap.alias("gap"), F.col("grid"), F.col("control"))).alias("b"))
    return best.join(made, group).join(groups.select(*group, "sharing"), group).select(*keys, "events", "sharing", "simulations", "own", F.col("b.grid").alias("target"), F.col("b.control").alias("control"), F.col("b.gap").alias("gap"))


def _from_first(bars: DataFrame, events: DataFrame, keys: list[str], series_keys: list[str]) -> DataFrame:
    """The bars of each schedule from its first event on, with its targets."""
    first = events.groupBy(*keys).agg(F.min("date").alias("_first"))
    return bars.join(first, series_keys).filter(F.col("date") >= F.col("_first")).join(events.select(*keys, "date", "target"), [*keys, "date"], "left").drop("_first")


def segmented_cash(calendar: DataFrame, rates: DataFrame, keys: list[str], percent: str, stale: int = 7) -> DataFrame:
    """Wealth of cash on a calendar whose intervals hold rate changes: dates of both are merged, each stretch between neighbours
    earns the rate last observed at its beginning, and no row is made per day. A stretch that ends more than `stale` days after its observation is refused: from
    then on there is no wealth, and `refused` tells the first day without a rate that is fresh enough. calendar: keys, date; rates: keys, date, percent. segments: stretches since the date before."""
    marks = calendar.select(*keys, "date", F.lit(1).alias("_on"), F.lit(None).cast("double").alias("_p")).unionByName(rates.select(*keys, "date", F.lit(0).alias("_on"), F.col(percent).cast("double").alias("_p")))
    points = marks.groupBy(*keys, "date").agg(F.max("_on").alias("_on"), F.max("_p").alias("_p"))
    w, upto = series(keys), over(keys)
    rate, seen = F.last("_p", ignorenulls=True).over(upto), F.last(F.when(F.col("_p").isNotNull(), F.col("date")), ignorenulls=True).over(upto)
    x = points.withColumn("_rate", rate).withColumn("_seen", seen).withColumn("_next", F.lead("date").over(w)).withColumn("_begun", F.max("_on").over(upto) == 1)
    # the stretch that begins here
    good = F.coalesce(F.datediff("_next", "_seen") <= stale, F.lit(False)) & F.coalesce(F.col("_rate") < 360 / 91 * 100, F.lit(False))
    too_old = F.greatest(F.date_add("date", 1), F.coalesce(F.date_add("_seen", stale + 1), F.date_add("date", 1)))
    x = x.withColumn("_bad", F.when(F.col("_begun") & F.col("_next").isNotNull() & ~good, too_old))
    x = x.withColumn("_g", F.when(F.col("_begun") & good, F.log(discount_growth(F.col("_rate"), F.lit(1))) * F.datediff("_next", "date")).otherwise(0.0)).withColumn("_one", F.col("_begun").cast("int"))
    done = upto.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("wealth", F.exp(F.coalesce(F.sum("_g").over(done), F.lit(0.0)))).withColumn("refused", F.min("_bad").over(done)).withColumn("_s", F.coalesce(F.sum("_one").over(done), F.lit(0)))
    on = x.filter("_on = 1").withColumn("segments", F.col("_s") - F.coalesce(F.lag("_s").over(w), F.col("_s")))
    return on.select(*keys, "date", F.when(F.col("refused").isNull(), F.col("wealth")).alias("wealth"), "refused", F.col("segments").cast("long").alias("segments"))
