"""Policies with borrowed money and margins, whose costs depend on what is held; shareholder tables and auctions."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import texts
from ..functions.numbers import DAYS_PER_YEAR, displayed, overlay_exposure
from .windows import full_mean, log_return, over, series

_PATH = T.StructType([T.StructField(c, T.DoubleType()) for c in ("wealth", "exposure", "traded", "financing")])


def traded_to(wealth: float, risk: float, target: float, cost: float) -> tuple[float, float]:
    """Risky amount and wealth after trading to a share of the wealth that is left."""
    if abs(target * wealth - risk) <= 1e-14 * wealth:
        return risk, wealth
    sign = 1 if target * wealth > risk else -1
    after = target * (wealth + sign * cost * risk) / (1 + sign * target * cost)
    return after, wealth - cost * abs(after - risk)


def leveraged(rows: DataFrame, keys: list[str], cost: float, borrow: float, cash: float = 0.0, floor: float | None = None) -> DataFrame:
    """The path of a policy whose `target` exposure, decided at a close, is traded at the next one; null targets change nothing.

    Money in cash earns `cash` a year, negative cash pays `borrow`, by calendar days. If wealth is gone, or its share
    in what is held falls below the margin `floor`, all is sold and nothing is held any more."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date").reset_index(drop=True)
        dates, close, target = pd.to_datetime(pdf["date"]), pdf["close"].to_numpy(float), pdf["target"].to_numpy(float)
        risk, idle, over_, paid, moved = 1.0, 0.0, False, 0.0, 0.0
        out = []
        for t in range(len(pdf)):
            if t and not over_:
                years = (dates[t] - dates[t - 1]).days / DAYS_PER_YEAR
                grown = idle * math.exp((borrow if idle < 0 else cash) * years)
                paid += max(0.0, idle - grown)
                risk, idle = risk * close[t] / close[t - 1], grown
                wealth = risk + idle
                if wealth <= 0:
                    risk, idle, over_ = 0.0, 0.0, True
                elif floor is not None and risk > 0 and wealth / risk < floor:
                    idle, risk, over_ = wealth - cost * risk, 0.0, True
                elif np.isfinite(target[t - 1]):
                    after, wealth = traded_to(wealth, risk, target[t - 1], cost)
                    moved += abs(after - risk)
                    risk, idle = after, wealth - after
            wealth = risk + idle
            out.append((wealth, risk / wealth if wealth > 0 else 0.0, moved, paid))
        return pd.concat([pdf[[*keys, "date"]], pd.DataFrame(out, columns=_PATH.names)], axis=1)

    fields = {f.name: f for f in rows.schema.fields}
    return rows.select(*keys, "date", "close", "target").groupBy(*keys).applyInPandas(fold, T.StructType([*(fields[c] for c in (*keys, "date")), *_PATH.fields]))


def sentiment_overlay(rows: DataFrame, keys: list[str], cost: float = 0.005, borrow: float = 0.05) -> DataFrame:
    """Half more than all in fear, half in greed, all otherwise."""
    return leveraged(rows.withColumn("target", overlay_exposure(F.col("score"))), keys, cost, borrow)


def scheduled(bars: DataFrame, schedule: DataFrame, keys: list[str]) -> DataFrame:
    """bars with `target` at the last bar of each month of a schedule (keys, month, target)."""
    month = F.trunc("date", "month")
    last = F.max("date").over(Window.partitionBy(*keys, month)) == F.col("date")
    rows = bars.withColumn("month", month).join(schedule.select(*keys, "month", "target"), [*keys, "month"], "left")
    return rows.withColumn("target", F.when(last, F.col("target"))).drop("month")


def switched(scores: DataFrame, winners: DataFrame, keys: list[str]) -> DataFrame:
    """Position under thresholds that change with the year; before the first year of winners all in, and across a change the position stays until an event."""
    from .positions import last_event

    rows = scores.withColumn("year", F.year("date")).join(F.broadcast(winners.select("year", "fear", "greed")), "year", "left")  # a row per year
    shown = displayed(F.col("score"))
    return last_event(rows, keys, F.when(shown >= F.col("greed"), 0).when(shown <= F.col("fear"), 1), 1).drop("year")


def cash_episodes(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Times out of the market that began and ended: when, and how many bars."""
    w = series(keys)
    rows = positions.withColumn("_i", F.row_number().over(w)).withColumn("_p", F.lag("position").over(w)).filter("_p is not null and _p != position")
    nxt = rows.withColumn("_end", F.lead("date").over(w)).withColumn("_j", F.lead("_i").over(w))
    return nxt.filter("position = 0 and _end is not null").select(*keys, F.col("date").alias("out"), F.col("_end").alias("back"), (F.col("_j") - F.col("_i")).alias("bars"))


def cross_market(signals: DataFrame, prices: DataFrame, days: int = 7) -> DataFrame:
    """Every market's score, at most so many days old, on every other market's bars. signals: market, date, score; prices: market, date, close."""
    from .windows import as_of

    pairs = prices.select(F.col("market").alias("traded"), "date", "close")
    fresh = as_of(pairs.select("traded", "date"), signals.filter("score is not null").select(F.col("market").alias("signal"), "date", "score").crossJoin(prices.select(F.col("market").alias("traded")).distinct()), ["traded"], ["score"], days, ("signal",))
    return fresh.filter("signal != traded and score is not null").join(pairs, ["traded", "date"])


def participation(segments: DataFrame, keys: list[str], member: str, n: int = 100, least: int = 2) -> DataFrame:
    """Mean bounded trend score of the segments and the share of them above their own mean, on dates that at least `least` have."""
    own = [*keys, member]
    r = segments.withColumn("_r", log_return(F.col("close"), own))
    gap = F.log(F.col("close") / full_mean(F.col("close"), own, n))
    sd = F.when(F.count("_r").over(over(own, 62)) == 63, F.stddev_samp("_r").over(over(own, 62)))
    scored = r.withColumn("_g", gap).withColumn("_s", F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 25 * gap / (sd * 20**0.5)))).filter("_g is not null")
    out = scored.groupBy(*keys, "date").agg(F.avg("_s").alias("score"), F.avg((F.col("_g") > 0).cast("double")).alias("above"), F.count("*").alias("n"))
    return out.filter(F.col("n") >= least)


def item_of(text: str, key: str) -> tuple[str | None, str | None]:
    """The value (as JSON) and date of the item with a key: of its whole object if that can be read, else the value alone and the first date after it that is not another item's."""
    marker = f'"itemKey":"{key}","value":'
    at = text.find(marker)
    if at < 0:
        return None, None
    read = json.JSONDecoder().raw_decode
    try:
        value, end = read(text, at + len(marker))
    except ValueError:
        return None, None
    shown = json.dumps(value, ensure_ascii=False)
    try:
        return shown, read(text, text.rindex("{", 0, at))[0].get("creationDate")
    except (ValueError, AttributeError):
        head, sep, tail = text[end:].split('"itemKey":', 1)[0].partition('"creationDate":"')
        return shown, tail.split('"')[0] if sep and head.startswith(",") else None


def item_values(pages: DataFrame, html: str, key: str) -> DataFrame:
    """pages with `value` (JSON text) and `dated` of an item that is embedded with once-escaped quotes."""

    def take(texts_: pa.Array) -> pa.Array:
        found = [item_of((t.as_py() or "").replace('\\"', '"'), key) for t in texts_]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["value", "dated"])

    both = F.arrow_udf(take, "struct<value: string, dated: string>")
    return pages.withColumn("_v", both(F.col(html))).withColumn("value", F.col("_v.value")).withColumn("dated", texts.kap_date(F.col("_v.dated"))).drop("_v")


def shareholders(items: DataFrame, keys: list[str]) -> DataFrame:
    """keys, dated, holder, shares, pct, voting_pct, other, total from the table's JSON."""
    kind = "array<struct<shareholder: string, shareInCapital: string, ratioInCapital: string, votingRightRatio: string>>"
    rows = items.select(*keys, "dated", F.explode(F.from_json("value", kind)).alias("r"))
    holder = F.trim(F.regexp_replace("r.shareholder", r"\s+", " "))
    number = lambda c: texts.turkish_number(F.col(f"r.{c}"))
    return rows.select(*keys, "dated", holder.alias("holder"), number("shareInCapital").alias("shares"), number("ratioInCapital").alias("pct"), number("votingRightRatio").alias("voting_pct"), holder.rlike("(?i)^(diğer|other)").alias("other"), holder.rlike("(?i)^(toplam|total)").alias("total"))


def holder_changes(rows: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """Changes of holders between consecutive observations of a table: listed, no longer listed, up, down, capital change."""
    times = rows.select(*keys, seen).distinct().withColumn("_next", F.lead(seen).over(Window.partitionBy(*keys).orderBy(seen)))
    a = rows.join(times, [*keys, seen]).filter("_next is not null").select(*keys, F.col("_next").alias(seen), "holder", F.col("shares").alias("shares_from"), F.col("pct").alias("pct_from"))
    later = rows.join(times.select(*keys, F.col("_next").alias(seen)).filter(f"{seen} is not null"), [*keys, seen], "left_semi")
    b = later.select(*keys, seen, "holder", F.col("shares").alias("shares_to"), F.col("pct").alias("pct_to"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [*keys, seen, "holder"], "full")
    kind = F.when(F.col("_a").isNull(), "listed").when(F.col("_b").isNull(), "no longer listed").when(F.col("pct_to") > F.col("pct_from"), "up").when(F.col("pct_to") < F.col("pct_from"), "down").otherwise("capital change")
    same = F.col("_a").isNotNull() & F.col("_b").isNotNull() & (F.abs(F.col("shares_to") - F.col("shares_from")) < 1) & F.col("pct_to").eqNullSafe(F.col("pct_from"))
    return both.filter(~same).withColumn("kind", kind).drop("_a", "_b")


def auctions(rows: DataFrame) -> DataFrame:
    """Bill auctions with the price that buyers paid: the average one under the multiple-price format until November 1998, the highest one since."""
    single = F.col("auction_date") >= F.lit("1998-11-02").cast("date")
    price = F.when(single, F.col("high_price")).otherwise(F.col("avg_med_price"))
    days = F.datediff("maturity_date", "issue_date")
    ok = (F.col("security_term") == "13-Week") & (F.col("auction_date") <= F.col("issue_date")) & days.between(1, 366) & (price > 0)
    return rows.filter(ok).select("cusip", "auction_date", "issue_date", "maturity_date", days.alias("days"), price.alias("price"), (100 / price - 1).alias("growth"))


def new_intervals(entries: DataFrame, marked: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Entries that end after all marked ones and aren't marked, the latest `limit`: what a notifier has to tell."""
    last = marked.agg(F.max("to").alias("last"))
    fresh = entries.join(marked.select(*keys, "to"), [*keys, "to"], "left_anti").crossJoin(F.broadcast(last)).filter("last is null or to > last").drop("last")
    return fresh.orderBy(F.desc("to"), *keys).limit(limit)


def shift_offsets(n: Column, most: int) -> Column:
    """The distinct offsets floor(k * n / (most + 1)), k from 1 to most, without 0."""
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.floor(k * n / (most + 1))), lambda x: x > 0))
