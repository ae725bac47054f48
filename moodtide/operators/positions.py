"""Positions from scores, and what they earn. A decision at a close takes effect at the next one: `position` is held
over the bar's interval to the next close. Rows: keys, date, close, score."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import displayed
from . import scan
from .windows import full_mean, over, series


def last_event(df: DataFrame, keys: list[str], event: Column, initial: float) -> DataFrame:
    """position: the last non-null event before the row. Enough for any rule whose events don't depend on the state."""
    before = series(keys).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_event", event.cast("double")).withColumn("position", F.coalesce(F.last("_event", ignorenulls=True).over(before), F.lit(float(initial)))).drop("_event")


def hysteresis(df: DataFrame, keys: list[str], fear: Column | float, greed: Column | float, initial: float = 1, cadence: int = 1, anchor: int = 0) -> DataFrame:
    """In at or below `fear`, out at or above `greed`, looked at every `cadence` bars."""
    shown = displayed(F.col("score"))
    due = F.pmod(F.row_number().over(series(keys)) - 1 - anchor, F.lit(cadence)) == 0
    return last_event(df.withColumn("_due", due), keys, F.when(F.col("_due") & (shown >= greed), 0).when(F.col("_due") & (shown <= fear), 1), initial).drop("_due")


def month_end_hysteresis(df: DataFrame, keys: list[str], fear: float, greed: float, initial: float = 1) -> DataFrame:
    shown = displayed(F.col("score"))
    ends = df.withColumn("_end", F.trunc(F.lead("date").over(series(keys)), "month") != F.trunc("date", "month"))
    return last_event(ends, keys, F.when(F.col("_end") & (shown >= greed), 0).when(F.col("_end") & (shown <= fear), 1), initial).drop("_end")


def long_short(df: DataFrame, keys: list[str], fear: float, greed: float, always: bool) -> DataFrame:
    shown = displayed(F.col("score"))
    event = F.when(shown >= greed, -1).when(shown.isNotNull(), 1) if always else F.when(shown <= fear, 1).when(shown >= greed, -1).when(shown.isNotNull(), 0)
    return last_event(df, keys, event, 1)


def above_level(df: DataFrame, keys: list[str], level: float) -> DataFrame:
    shown = displayed(F.col("score"))
    return last_event(df, keys, F.when(shown.isNotNull(), (shown >= level).cast("int")), 1)


def above_own_mean(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """In while the score is above the mean of the last n scores there are."""
    have = df.filter("score is not null").withColumn("_mean", full_mean(F.col("score"), keys, n)).select(*keys, "date", "_mean")
    both = df.join(have, [*keys, "date"], "left")
    return last_event(both, keys, F.when(F.col("_mean").isNotNull(), (F.col("score") > F.col("_mean")).cast("int")), 1).drop("_mean")


def folded(df: DataFrame, keys: list[str], out: T.StructType, fold: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """A rule whose next state depends on its last, over each series in order. A series is one group: a bar per day."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: fold(pdf.sort_values("date").reset_index(drop=True)), T.StructType([*df.schema.fields, *out.fields]))


_POSITION = T.StructType([T.StructField("position", T.DoubleType())])


def fear_then_time(df: DataFrame, keys: list[str], fear: float, hold: int) -> DataFrame:
    """In for `hold` bars after a score at or below `fear`; no new entry meanwhile. The state is the number of bars left."""
    enter = F.coalesce(displayed(F.col("score")) <= fear, F.lit(False))
    steps = [F.when(enter, hold).otherwise(0), *(F.lit(left - 1) for left in range(1, hold + 1))]
    return scan.states(df, keys, steps, 0).withColumn("position", (F.col("before") > 0).cast("double")).drop("before", "after")


def continuous(df: DataFrame, keys: list[str], contrarian: bool, band: float = 0.10) -> DataFrame:
    """A share of the score (or of what it lacks to 100), changed only by more than `band`."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        now, out = 1.0, [1.0]
        for s in pdf["score"][:-1]:
            target = (100 - s) / 100 if contrarian else s / 100
            if pd.notna(s) and abs(target - now) > band:
                now = target
            out.append(now)
        return pdf.assign(position=out[: len(pdf)])

    return folded(df, keys, _POSITION, fold)


def armed_trend(df: DataFrame, keys: list[str], fear: float, greed: float, days: int = 90) -> DataFrame:
    """A fear score arms a purchase for `days`, renewed by further ones; it is carried out once `trend_up`. Greed disarms and sells.

    States: out, out and armed, in, in and armed. While armed, the date that counts is that of the last fear score, whatever the state was."""
    shown = F.coalesce(displayed(F.col("score")), F.lit((int(fear) + int(greed)) // 2))
    fearful, greedy, up = shown <= fear, shown >= greed, F.coalesce(F.col("trend_up"), F.lit(False))
    since = F.last(F.when(displayed(F.col("score")) <= fear, F.col("date")), ignorenulls=True).over(over(keys))
    rows = df.withColumn("_stale", F.coalesce(F.datediff("date", since) > days, F.lit(False)))

    def leads(invested: bool, armed: bool) -> Column:
        is_armed = F.lit(True) if armed else fearful
        kept = 2 if invested else 0
        carried_out = F.lit(False) if invested else is_armed & up
        return F.when(greedy, 0).when(is_armed & F.col("_stale"), kept).when(carried_out, 2).when(is_armed, kept + 1).otherwise(kept)

    done = scan.states(rows, keys, [leads(False, False), leads(False, True), leads(True, False), leads(True, True)], 2)
    return done.withColumn("position", (F.col("before") >= 2).cast("double")).drop("before", "after", "_stale")


def wealth(df: DataFrame, keys: list[str], cost: Column | float = 0.0, borrow: float = 0.0, cash: Column | None = None) -> DataFrame:
    """Wealth along the path of `position`: each change costs a share of wealth for each unit changed, a
    short position pays `borrow` per interval, and what is not invested grows by `cash` (growth over the interval that ends here).
    Wealth that is lost stays lost. Adds held (over the interval that ends here), growth, wealth and turnover."""
    w = series(keys)
    held = F.lag("position").over(w)
    rows = df.withColumn("held", held).withColumn("_change", F.abs(F.col("position") - F.coalesce("held", "position")))
    move = F.col("close") / F.lag("close").over(w) - 1
    idle = (1 - F.col("held")) * (cash - 1) if cash is not None else F.lit(0.0)
    factor = 1 + F.col("held") * move + idle - F.when(F.col("held") < 0, -F.col("held") * borrow).otherwise(0.0)
    rows = rows.withColumn("growth", F.coalesce(factor, F.lit(1.0)) * (1 - cost * F.col("_change")))
    upto = over(keys)
    ruined = F.max((F.col("growth") <= 0).cast("int")).over(upto) == 1
    level = F.exp(F.sum(F.when(F.col("growth") > 0, F.log("growth")).otherwise(0.0)).over(upto))
    return rows.withColumn("wealth", F.when(ruined, 0.0).otherwise(level)).withColumn("turnover", F.sum("_change").over(upto)).drop("_change")


def cycles(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fills of each kind, completed times in cash, longest runs in and out, and the share of time invested."""
    w = series(keys)
    rows = df.withColumn("_p", F.lag("position").over(w)).withColumn("_i", F.row_number().over(w))
    rows = rows.withColumn("_run", F.col("_i") - F.row_number().over(Window.partitionBy(*keys, "position").orderBy("date")))
    runs = rows.filter(F.col("_p").isNotNull() | (F.col("_i") == 1)).groupBy(*keys, "position", "_run").agg(F.count("*").alias("n"))
    longest = runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("position") == 1, F.col("n"))), F.lit(0)).alias("longest_in"), F.coalesce(F.max(F.when(F.col("position") == 0, F.col("n"))), F.lit(0)).alias("longest_out"))
    buys, sells = F.col("position") > F.col("_p"), F.col("position") < F.col("_p")
    counted = rows.groupBy(*keys).agg(F.count(F.when(buys, 1)).alias("buys"), F.count(F.when(sells, 1)).alias("sells"), F.avg("position").alias("invested"))
    return counted.join(longest, keys)


def placebo(actual: DataFrame, shifted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Where an actual value stands among those of shifted scores: midrank percentile and finite-sample p."""
    a = actual.select(*keys, F.col(value).alias("actual"))
    x = F.col(value)
    return shifted.join(a, keys).groupBy(*keys, "actual").agg(
        F.count("*").alias("shifts"), F.median(x).alias("median"), F.max(x).alias("best"),
        ((F.count(F.when(x < F.col("actual"), 1)) + 0.5 * F.count(F.when(x == F.col("actual"), 1))) / F.count("*")).alias("percentile"),
        ((1 + F.count(F.when(x >= F.col("actual"), 1))) / (1 + F.count("*"))).alias("p"),
    )
