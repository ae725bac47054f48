"""Sentiment queries: components, percentiles, as-of alignment, composite."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import sentiment, windows as W
from ..operators.lineage import cut
from ..sources.bars import REGION_SQL, SLOT_SQL, SLOTS, region_bars, slot_bars

S = ["symbol"]
r6 = lambda c, name=None: F.round(c, 6).alias(name or c)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


def markets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Index bars by market, and the bars of each slot, the same for every market. Both are a row per series and day, and written, since several components read them: the order lines are aggregated once."""
    index = cut(region_bars(spark, sf_dir).withColumnRenamed("symbol", "market"))
    names = index.select("market").distinct()
    slots = cut(slot_bars(spark, sf_dir).filter(F.col("symbol").isin(*SLOTS.values())))
    return index, {slot: slots.filter(F.col("symbol") == s).drop("symbol").join(names) for slot, s in SLOTS.items()}


def sma_momentum(spark, sf_dir):
    m = W.momentum(region_bars(spark, sf_dir), S)
    return rounded(m.filter("raw is not null"), "raw")


def strength(spark, sf_dir):
    return rounded(W.strength(region_bars(spark, sf_dir), S).filter("raw is not null"), "raw")


def realised_vol(spark, sf_dir):
    return rounded(W.realised_vol(region_bars(spark, sf_dir), S).filter("raw is not null"), "raw")


def vol_vs_mean(spark, sf_dir):
    return rounded(W.relative_to_mean(W.realised_vol(region_bars(spark, sf_dir), S), S).filter("raw is not null"), "raw")


def safe_haven(spark, sf_dir):
    index, slots = markets(spark, sf_dir)
    return rounded(W.return_gap(index, slots["bond"], ["market"]).filter("raw is not null"), "raw")


def credit_ratio(spark, sf_dir):
    _, slots = markets(spark, sf_dir)
    return rounded(W.ratio_vs_mean(slots["hy"], slots["ig"], ["market"], 125).filter("raw is not null"), "raw")


def expanding_percentile(spark, sf_dir):
    p = W.expanding_midrank(W.momentum(slot_bars(spark, sf_dir), S), S)
    return p.filter("score is not null").select("symbol", "date", r6("score"), N.label(F.col("score")).alias("label"), N.legacy_label(F.col("score")).alias("legacy"))


def trailing_percentile(spark, sf_dir):
    p = W.trailing_midrank(W.momentum(slot_bars(spark, sf_dir), S), S)
    return p.filter("score is not null").select("symbol", "date", r6("score"))


def asof_slots(spark, sf_dir):
    """The latest close of each return flag and line status on every day of the first return flag's calendar, at most 2 days old."""
    bars = slot_bars(spark, sf_dir)
    calendar = bars.filter("symbol = 'A'").select(F.lit("all").alias("market"), "date")
    return W.as_of(calendar, bars.withColumn("market", F.lit("all")), ["market"], ["close"], 2, ("symbol",)).filter("close is not null").select("symbol", "date", "close", "as_of")


def equal_weight(spark, sf_dir):
    bars = slot_bars(spark, sf_dir).filter("length(symbol) = 1").withColumn("basket", F.lit("flags"))
    index = W.equal_weight_index(bars, ["basket"], "symbol")
    return index.select("basket", "date", F.round(F.log("close"), 6).alias("log_level"))


def trailing_mean_available(spark, sf_dir):
    bars = slot_bars(spark, sf_dir).withColumn("v", F.when(F.pmod(F.dayofmonth("date"), F.lit(3)) != 0, F.col("close")))
    return rounded(W.mean_of_available(bars, "v", S, 10, "mean10").select("symbol", "date", "mean10"), "mean10")


def composite_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, slots = markets(spark, sf_dir)
    return sentiment.composite(index, sentiment.scored(sentiment.components(index, slots)))


def sentiment_composite(spark, sf_dir):
    c = composite_frame(spark, sf_dir)
    return c.select("market", "date", r6("score"), "n", N.label(F.round("score", 6)).alias("label"), N.decision(F.round("score", 6), 24, 75).alias("decision"))


def composite_lookback(spark, sf_dir):
    return rounded(sentiment.lookback(composite_frame(spark, sf_dir)), "score", "previous", "week", "month", "year")


def label_sql(x: str) -> str:
    return f"case when {x} < 0 or {x} > 100 then null when {x} >= 75 then 'Extreme Greed' when {x} >= 56 then 'Greed' when {x} >= 45 then 'Neutral' when {x} >= 25 then 'Fear' else 'Extreme Fear' end"


ONE, TWO = "floor(score * 10 + 0.5) / 10", "floor(floor(score * 10 + 0.5) / 10 + 0.5)"


def momentum_sql(source: str, key: str = "symbol") -> str:
    return f"select {key}, date, 100 * (close / (case when count(*) over w = 125 then avg(close) over w end) - 1) as raw from {source} window w as (partition by {key} order by date rows 124 preceding)"


VOL_SQL = """returns as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars),
vol as (select symbol, date, case when count(r) over w = 20 then stddev_samp(r) over w * sqrt(252) * 100 end as raw from returns window w as (partition by symbol order by date rows 19 preceding)),
rel as (select symbol, date, case when count(raw) over w >= 40 and row_number() over (partition by symbol order by date) >= 50 then 100 * (raw / avg(raw) over w - 1) end as raw from vol window w as (partition by symbol order by date rows 49 preceding))"""
STRENGTH_SQL = "select symbol, date, 100 * (close / (case when count(*) over w >= 126 then max(close) over w end) - 1) as raw from region_bars window w as (partition by symbol order by date rows 251 preceding)"
HAVEN_SQL = "select symbol as market, date, 100 * (x / lag(x, 20) over w - y / lag(y, 20) over w) as raw from (select a.symbol, a.date, a.close as x, b.close as y from region_bars a join slot_bars b on a.date = b.date and b.symbol = 'A') window w as (partition by symbol order by date)"


def ratio_sql(a: str, b: str, n: int) -> str:
    return f"""select m.symbol as market, date, raw from (select date, 100 * (q / (case when count(*) over w = {n} then avg(q) over w end) - 1) as raw
  from (select x.date, x.close / y.close as q from slot_bars x join slot_bars y on x.date = y.date where x.symbol = '{a}' and y.symbol = '{b}') window w as (order by date rows {n - 1} preceding)), (select distinct symbol from region_bars) m"""


COMPOSITE_SQL = f"""with {REGION_SQL}, {SLOT_SQL}, {VOL_SQL},
parts as (
  select symbol as market, 'momentum' as component, date, raw from ({momentum_sql('region_bars')})
  union all select symbol, 'strength', date, raw from ({STRENGTH_SQL})
  union all select symbol, 'volatility', date, raw from rel
  union all select market, 'safeHaven', date, raw from ({HAVEN_SQL})
  union all select market, 'credit', date, raw from ({ratio_sql('N', 'R', 125)})
  union all select market, 'breadth', date, raw from ({ratio_sql('ON', 'FR', 63)})),
fin as (select * from parts where raw is not null),
ranked as (
  select a.market, a.component, a.date, count(*) as n, 100.0 * sum(case when b.raw < a.raw then 1.0 when b.raw = a.raw then 0.5 else 0 end) / count(*) as score
  from fin a join fin b on a.market = b.market and a.component = b.component and b.date <= a.date group by 1, 2, 3),
scores as (select market, component, date, case when component = 'volatility' then 100 - score else score end as score from ranked where n >= 126),
cal as (select r.symbol as market, r.date, c.component from region_bars r, (select distinct component from parts) c),
fresh as (select cal.market, cal.date, s.score, s.date as as_of from cal asof join scores s on cal.market = s.market and cal.component = s.component and cal.date >= s.date),
composite as (select market, date, avg(score) as score, count(*)::int as n from fresh where date_diff('day', as_of, date) <= 7 group by 1, 2 having count(*) >= 6)"""

QUERIES = {f.__name__: f for f in (sma_momentum, strength, realised_vol, vol_vs_mean, safe_haven, credit_ratio, expanding_percentile, trailing_percentile, asof_slots, equal_weight, trailing_mean_available, sentiment_composite, composite_lookback)}

ORACLES = {
    "sma_momentum": f"with {REGION_SQL} select symbol, date, round(raw, 6) as raw from ({momentum_sql('region_bars')}) where raw is not null",
    "strength": f"with {REGION_SQL} select symbol, date, round(raw, 6) as raw from ({STRENGTH_SQL}) where raw is not null",
    "realised_vol": f"with {REGION_SQL}, {VOL_SQL} select symbol, date, round(raw, 6) as raw from vol where raw is not null",
    "vol_vs_mean": f"with {REGION_SQL}, {VOL_SQL} select symbol, date, round(raw, 6) as raw from rel where raw is not null",
    "safe_haven": f"with {REGION_SQL}, {SLOT_SQL} select market, date, round(raw, 6) as raw from ({HAVEN_SQL}) where raw is not null",
    "credit_ratio": f"with {REGION_SQL}, {SLOT_SQL} select market, date, round(raw, 6) as raw from ({ratio_sql('N', 'R', 125)}) where raw is not null",
    "expanding_percentile": f"""with {SLOT_SQL}, m as (select * from ({momentum_sql('slot_bars')}) where raw is not null),
p as (select a.symbol, a.date, count(*) as n, 100.0 * sum(case when b.raw < a.raw then 1.0 when b.raw = a.raw then 0.5 else 0 end) / count(*) as score from m a join m b on a.symbol = b.symbol and b.date <= a.date group by 1, 2)
select symbol, date, round(score, 6) as score, {label_sql(ONE)} as label, {label_sql(TWO)} as legacy from p where n >= 126""",
    "trailing_percentile": f"""with {SLOT_SQL}, m as (select *, row_number() over (partition by symbol order by date) as i from ({momentum_sql('slot_bars')})),
p as (select a.symbol, a.date, count(b.raw) as n, 100.0 * sum(case when b.raw < a.raw then 1.0 when b.raw = a.raw then 0.5 else 0 end) / count(b.raw) as score from m a join m b on a.symbol = b.symbol and b.i between a.i - 251 and a.i where a.raw is not null group by 1, 2)
select symbol, date, round(score, 6) as score from p where n >= 126""",
    "asof_slots": f"""with {SLOT_SQL}, cal as (select c.date, s.symbol from slot_bars c, (select distinct symbol from slot_bars) s where c.symbol = 'A')
select cal.symbol, cal.date, b.close, b.date as as_of from cal asof join slot_bars b on cal.symbol = b.symbol and cal.date >= b.date where date_diff('day', b.date, cal.date) <= 2""",
    "equal_weight": f"""with {SLOT_SQL}, f as (select * from slot_bars where length(symbol) = 1), c as (select date from f group by date having count(*) = (select count(distinct symbol) from f)),
g as (select date, close / lag(close) over (partition by symbol order by date) as g from f where date in (select date from c)), d as (select date, avg(g) as g from g group by date)
select 'flags' as basket, date, round(ln(100) + sum(coalesce(ln(g), 0)) over (order by date), 6) as log_level from d""",
    "trailing_mean_available": f"""with {SLOT_SQL}, h as (select symbol, date, case when count(*) over w = 10 then avg(close) over w end as m from slot_bars where day(date) % 3 <> 0 window w as (partition by symbol order by date rows 9 preceding))
select b.symbol, b.date, round(h.m, 6) as mean10 from slot_bars b left join h on b.symbol = h.symbol and b.date = h.date""",
    "sentiment_composite": COMPOSITE_SQL + f", c as (select market, date, round(score, 6) as score, n from composite) select market, date, score, n, {label_sql(ONE)} as label, case when {TWO} <= 24 then 'BUY' when {TWO} >= 75 then 'SELL' else 'HOLD' end as decision from c",
    "composite_lookback": COMPOSITE_SQL + """, l as (select *, max(date) over (partition by market) as last, row_number() over (partition by market order by date desc) as k from composite)
select market, max(date) as date, round(max_by(score, date), 6) as score, round(max(case when k = 2 then score end), 6) as previous, round(max_by(score, date) filter (date <= last - 7), 6) as week,
round(max_by(score, date) filter (date <= last - 30), 6) as month, round(max_by(score, date) filter (date <= last - 365), 6) as year from l group by market""",
}
