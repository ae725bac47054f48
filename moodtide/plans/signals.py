"""Completed bars, labels, normalised components, rules on labels, selections and audits over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import half_up
from ..operators import outcomes as O, policies as K, positions as P, signals as G, windows as W
from ..sources.bars import REGION_SQL, SLOT_SQL, SLOTS, region_bars, slot_bars, table
from .outcomes import momentum_scores
from .sentiment import rounded
from .trading import DAMPED, HYST, S, _terminal, event_sql, scored, wealth_sql


def completed_bars(spark, sf_dir):
    """Bars retrieved late on their last day: complete where that day is over, not where it still runs."""
    bars = region_bars(spark, sf_dir)
    east = F.col("symbol").isin("ASIA", "MIDDLE EAST")
    fetched = bars.groupBy("symbol").agg((F.max("date").cast("timestamp_ntz") + F.expr("interval 20 hours")).alias("fetched_at")).withColumn("tz", F.when(east, "+09:00").otherwise("-05:00"))
    done = G.completed(bars.join(fetched, "symbol"))
    return done.groupBy("symbol").agg(F.max("date").alias("last"), F.count("*").alias("n"))


def normalised_labels(spark, sf_dir):
    texts = F.array(*map(F.lit, ("  Extreme_Fear", "FEAR ", "neutral", "Extreme--greed", "unknown", "")))
    o = table(spark, sf_dir, "orders").withColumn("score", F.pmod("o_orderkey", F.lit(1009)) / 10)
    return o.select("o_orderkey", G.normalised_label(F.get(texts, F.pmod("o_orderkey", F.lit(7)).cast("int")), F.col("score")).alias("label"))


def sigma_components(spark, sf_dir):
    out = G.sigma_components(region_bars(spark, sf_dir), S)
    return rounded(out.filter("trend is not null"), *(c for c in out.columns if c not in ("symbol", "date")))


def relative_appetite(spark, sf_dir):
    safe = slot_bars(spark, sf_dir).filter("symbol = 'A'")
    return rounded(G.relative_appetite(region_bars(spark, sf_dir), safe, S), "appetite", "appetite_score")


def six_components(spark, sf_dir):
    """symbol, date and the six normalised components, on dates on which all are there; breadth is the participation of the segments."""
    bars, slots = region_bars(spark, sf_dir), slot_bars(spark, sf_dir)
    own = G.sigma_components(bars, S)
    safe = G.relative_appetite(bars, slots.filter("symbol = 'A'"), S).select("symbol", "date", F.col("appetite_score").alias("safe"))
    credit = G.relative_appetite(slots.filter("symbol = 'N'"), slots.filter("symbol = 'R'"), S).select("date", F.col("appetite_score").alias("credit"))
    segments = slots.filter(F.col("symbol").isin(SLOTS["small"], SLOTS["large"])).withColumn("market", F.lit("all"))
    breadth = K.participation(segments, ["market"], "symbol").select("date", F.col("score").alias("breadth"))
    scores = [F.col(f"{c}_score").alias(c) for c in ("trend", "strength", "volatility")]
    return own.join(safe, ["symbol", "date"]).join(credit, "date").join(breadth, "date").select("symbol", "date", *scores, "safe", "credit", "breadth").dropna()


def strict_composite(spark, sf_dir):
    """The mean of the six normalised components, all of which are required, exact and to one decimal."""
    rows = six_components(spark, sf_dir)
    mean = sum(F.col(c) for c in rows.columns[2:]) / 6
    return rounded(rows.select("symbol", "date", mean.alias("score")).withColumn("rounded", half_up(F.col("score"), 1)), "score")


def label_rules(spark, sf_dir):
    """Four rules that are in the market on some labels of the bar before, and holding, at ten basis points a trade."""
    bars = scored(spark, sf_dir).withColumn("label", G.normalised_label(F.lit(None).cast("string"), F.col("score")))
    rules = spark.sql("select * from values ('fear_only', 'Extreme Fear,Fear'), ('not_extreme_greed', 'Extreme Fear,Fear,Neutral,Greed'), ('greed_only', 'Greed,Extreme Greed'), ('not_extreme_fear', 'Fear,Neutral,Greed,Extreme Greed') as t(rule, labels)")
    keys = ["symbol", "rule"]
    held = G.label_positions(bars.crossJoin(F.broadcast(rules)), keys, F.array_contains(F.split("labels", ","), F.col("label")))
    done = P.wealth(held, keys, 0.001).groupBy(*keys).agg(F.max_by("wealth", "date").alias("wealth"), F.max("turnover").alias("turnover"), F.avg("position").alias("exposure"))
    return rounded(done, "wealth", "exposure")


def holm_rejections(spark, sf_dir):
    """The share of falls among each region's days by year as p values of one family a year."""
    moved = region_bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(W.series(S)))
    p = moved.groupBy("symbol", F.year("date").alias("year")).agg(F.round(F.pow(F.avg((F.col("r") < 1).cast("double")), 6), 6).alias("p"))
    return rounded(G.holm_step_down(p, "p", ["year"], ["symbol"]), "threshold")


def best_cells(spark, sf_dir):
    """Of each region's thresholds those with the largest wealth among the ones that trade, against holding."""
    grid = spark.sql("select explode(array(15, 20, 25)) as fear").crossJoin(spark.sql("select explode(array(70, 75, 80)) as greed"))
    bars, keys = scored(spark, sf_dir), ["symbol", "fear", "greed"]
    cells = rounded(_terminal(P.wealth(P.hysteresis(bars.crossJoin(F.broadcast(grid)), keys, F.col("fear"), F.col("greed")), keys, 0.0025), keys), "wealth")
    hold = bars.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("hold"))
    best = G.best_active(cells, S, "fear", "greed").join(hold, "symbol")
    return rounded(best.withColumn("ratio", F.col("wealth") / F.col("hold")).drop("hold"), "ratio")


def signal_audit(spark, sf_dir):
    """What becomes of each region's bars as observations: without a score, without a bar 21 later, or used; by year."""
    rows = momentum_scores(spark, sf_dir).withColumn("later", F.lead("close", 22).over(W.series(S)))
    fate = F.when(F.col("score").isNull(), "no signal").when(F.col("later").isNull(), "no outcome").otherwise("used")
    return rows.groupBy("symbol", F.year("date").alias("year"), fate.alias("fate")).agg(F.count("*").alias("n"))


def rebased_common(spark, sf_dir):
    """Closes on the dates that all regions have, each against its first."""
    bars = region_bars(spark, sf_dir)
    n = bars.select("symbol").distinct().agg(F.count("*").alias("n"))
    dates = bars.groupBy("date").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("date")
    first = F.first("close").over(W.over(S))
    return rounded(bars.join(dates, "date").select("symbol", "date", (F.col("close") / first).alias("level")), "level")


def training_windows(spark, sf_dir):
    return G.training_windows(region_bars(spark, sf_dir).select("symbol", "date"), S, 3, 400)


def last_bars(spark, sf_dir):
    """The last five closes of each series, latest first, and the mean of five as a moving one gives it there."""
    bars = region_bars(spark, sf_dir).unionByName(slot_bars(spark, sf_dir)).withColumn("mean5", W.full_mean(F.col("close"), S, 5))
    k = F.row_number().over(W.Window.partitionBy("symbol").orderBy(F.desc("date")))
    return rounded(bars.withColumn("k", k).filter("k <= 5").select("symbol", "k", "date", "close", "mean5"), "close", "mean5")


def common_curve(spark, sf_dir):
    """The mean of the regions' wealth by a rule, each from one at the first date that all have, on dates that all have."""
    bars = scored(spark, sf_dir)
    n = bars.select("symbol").distinct().agg(F.count("*").alias("n"))
    dates = bars.groupBy("date").agg(F.count("*").alias("k")).join(F.broadcast(n), F.col("k") == F.col("n")).select("date")
    path = P.wealth(P.hysteresis(bars.join(dates, "date"), S, 25, 75), S, 0.0025)
    return rounded(path.groupBy("date").agg(F.avg("wealth").alias("wealth"), F.avg("position").alias("exposure")), "wealth", "exposure")


def exposure_metrics(spark, sf_dir):
    """Excess over cash at 2 % a year of long and short positions: annual Sharpe ratio, turnover, extremes, and days short."""
    path = P.wealth(P.long_short(scored(spark, sf_dir), S, 25, 75, False), S, 0.0025)
    w = W.series(S)
    excess = F.col("wealth") / F.lag("wealth").over(w) - F.pow(F.lit(1.02), F.datediff("date", F.lag("date").over(w)) / 365.2425)
    rows = path.select("symbol", "date", "position", "turnover", excess.alias("excess"))
    out = rows.groupBy("symbol").agg(
        (F.avg("excess") / F.stddev_samp("excess") * F.sqrt(F.lit(252.0))).alias("sharpe"), F.max("turnover").alias("turnover"), F.min("position").alias("least"),
        F.max("position").alias("most"), F.avg((F.col("position") < 0).cast("double")).alias("short"), F.avg("position").alias("mean"),
    )
    return rounded(out, "sharpe", "short", "mean")


def excess_labels(spark, sf_dir):
    """The log return from the next close to the one after it, less cash at 2 % a year over those days."""
    w = W.series(S)
    days = F.datediff(F.lead("date", 2).over(w), F.lead("date", 1).over(w))
    label = F.log(F.lead("close", 2).over(w) / F.lead("close", 1).over(w)) - days / 365.2425 * F.log(F.lit(1.02))
    return rounded(region_bars(spark, sf_dir).select("symbol", "date", label.alias("excess")).filter("excess is not null"), "excess")


def list_mismatches(spark, sf_dir):
    """A list kept by hand (suppliers with keys not divisible by 11, balances rounded to tens, some names changed) against the live one: what differs."""
    live = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.trim("s_name").alias("name"), F.floor(F.col("s_acctbal") / 10).alias("value")).filter("k % 13 != 0")
    hand = table(spark, sf_dir, "supplier").filter("s_suppkey % 11 != 0").select(F.col("s_suppkey").alias("k2"), F.when(F.col("s_suppkey") % 7 == 0, F.lower(F.trim("s_name"))).otherwise(F.trim("s_name")).alias("name2"), (F.floor(F.col("s_acctbal") / 10) + (F.col("s_suppkey") % 5 == 0).cast("int")).alias("value2"))
    both = live.join(hand, F.col("k") == F.col("k2"), "full")
    reasons = F.array_compact(F.array(
        F.when(F.col("k2").isNull(), "not in the list"), F.when(F.col("k").isNull(), "only in the list"), F.when(F.col("name") != F.col("name2"), "name"), F.when(F.col("value") != F.col("value2"), "value"),
    ))
    return both.select(F.coalesce("k", "k2").alias("s_suppkey"), F.concat_ws(", ", reasons).alias("reasons")).filter("reasons != ''")


QUERIES = {f.__name__: f for f in (completed_bars, normalised_labels, sigma_components, relative_appetite, strict_composite, label_rules, holm_rejections, best_cells, signal_audit, rebased_common, training_windows, last_bars, common_curve, exposure_metrics, excess_labels, list_mismatches)}


def _C(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def _sigma(n: int, r: str = "r") -> str:
    w = f"over (partition by symbol order by date rows {n - 1} preceding)"
    return f"case when count({r}) {w} = {n} then greatest(stddev_samp({r}) {w}, 1e-6) end"


_MOVED = "moved as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars)"
_RAW = f"""raw as (select symbol, date, ln(close / case when count(*) over a = 200 then avg(close) over a end) / ({_sigma(63)} * sqrt(20.0)) as trend,
ln(close / case when count(*) over h = 252 then max(close) over h end) / ({_sigma(63)} * sqrt(20.0)) as strength, {_sigma(20)} / {_sigma(252)} as volatility from moved
window a as (partition by symbol order by date rows 199 preceding), h as (partition by symbol order by date rows 251 preceding)),
comps as (select *, {_C('50 + 25 * trend')} as trend_score, {_C('100 + 50 * strength')} as strength_score, {_C('50 - 50 * log2(volatility)')} as volatility_score from raw where trend is not null)"""


def _appetite(left: str, right: str, name: str) -> str:
    return f"""{name}x as (select l.symbol, l.date, ln(l.close / o.close) as x from ({left}) l join ({right}) o on l.date = o.date), {name}m as (select *, x - lag(x) over (partition by symbol order by date) as r from {name}x),
{name} as (select symbol, date, (x - lag(x, 20) over (partition by symbol order by date)) / ({_sigma(63)} * sqrt(20.0)) as appetite from {name}m)"""


_A, _N, _R = (f"select * from slot_bars where symbol = '{x}'" for x in "ANR")
_BAND = "case when floor(score * 10 + 0.5) / 10 between 0 and 100 then case when floor(score * 10 + 0.5) / 10 >= 75 then 'Extreme Greed' when floor(score * 10 + 0.5) / 10 >= 56 then 'Greed' when floor(score * 10 + 0.5) / 10 >= 45 then 'Neutral' when floor(score * 10 + 0.5) / 10 >= 25 then 'Fear' else 'Extreme Fear' end end"
_COMMON = "common as (select date from {0} group by date having count(*) = (select count(distinct symbol) from {0}))"
ORACLES = {
    "completed_bars": f"""with {REGION_SQL}, f as (select symbol, (max(date)::timestamp + interval 20 hour + case when symbol in ('ASIA', 'MIDDLE EAST') then interval 9 hour else -interval 5 hour end)::date as cutoff from region_bars group by symbol)
select symbol, max(date) as last, count(*) as n from region_bars join f using (symbol) where date < cutoff group by symbol""",
    "normalised_labels": f"""with o as (select o_orderkey, o_orderkey % 1009 / 10.0::double as score, o_orderkey % 7 as t from orders)
select o_orderkey, case t when 0 then 'Extreme Fear' when 1 then 'Fear' when 2 then 'Neutral' when 3 then 'Extreme Greed' else {_BAND} end as label from o""",
    "sigma_components": f"with {REGION_SQL}, {_MOVED}, {_RAW} select symbol, date, round(trend, 6) as trend, round(strength, 6) as strength, round(volatility, 6) as volatility, round(trend_score, 6) as trend_score, round(case when strength is not null then strength_score end, 6) as strength_score, round(case when volatility is not null then volatility_score end, 6) as volatility_score from comps",
    "relative_appetite": f"with {REGION_SQL}, {SLOT_SQL}, {_appetite('select * from region_bars', _A, 'p')} select symbol, date, round(appetite, 6) as appetite, round(case when appetite is not null then {_C('50 + 25 * appetite')} end, 6) as appetite_score from p",
    "label_rules": f"""with {DAMPED}, l as (select *, {_BAND} as label from b), g as (select l.*, rule, labels from l, (values ('fear_only', 'Extreme Fear,Fear'), ('not_extreme_greed', 'Extreme Fear,Fear,Neutral,Greed'), ('greed_only', 'Greed,Extreme Greed'), ('not_extreme_fear', 'Fear,Neutral,Greed,Extreme Greed')) t(rule, labels)),
p as (select *, coalesce(lag(list_contains(string_split(labels, ','), label)::int) over (partition by symbol, rule order by date), 0)::double as position from g), {wealth_sql('0.001', key='symbol, rule')}
select symbol, rule, round(max_by(wealth, date), 6) as wealth, max(turnover) as turnover, round(avg(position), 6) as exposure from w group by 1, 2""",
    "holm_rejections": f"""with {REGION_SQL}, {_MOVED}, t as (select symbol, year(date) as year, round(pow(avg((r < 0)::int::double), 6), 6) as p from moved group by 1, 2),
k as (select *, row_number() over (partition by year order by p, symbol) as rank, count(*) over (partition by year) as m from t), h as (select *, 0.05 / (m - rank + 1) as threshold from k)
select symbol, year, p, rank, round(threshold, 6) as threshold, bool_and(p <= threshold) over (partition by year order by rank rows unbounded preceding) as rejected from h""",
    "best_cells": f"""with {DAMPED}, g as (select b.*, fear, greed from b, (values (15), (20), (25)) f(fear), (values (70), (75), (80)) h(greed)), {event_sql('case when shown >= greed then 0 when shown <= fear then 1 end', 1, source='g', key='symbol, fear, greed')}, {wealth_sql('0.0025', key='symbol, fear, greed')},
t as (select symbol, fear, greed, round(max_by(wealth, date), 6) as wealth, max(turnover) as turnover from w group by 1, 2, 3), h as (select symbol, max_by(close, date) / min_by(close, date) as hold from b group by 1)
select symbol, fear, greed, wealth, turnover, round(wealth / hold, 6) as ratio from t join h using (symbol) where turnover > 0 and wealth > 0 qualify row_number() over (partition by symbol order by wealth desc, fear, greed) = 1""",
    "signal_audit": f"""with {DAMPED}, f as (select *, lead(close, 22) over (partition by symbol order by date) as later from b)
select symbol, year(date) as year, case when score is null then 'no signal' when later is null then 'no outcome' else 'used' end as fate, count(*) as n from f group by 1, 2, 3""",
    "rebased_common": f"with {REGION_SQL}, {_COMMON.format('region_bars')} select symbol, date, round(close / first_value(close) over (partition by symbol order by date), 6) as level from region_bars join common using (date)",
    "training_windows": f"""with {REGION_SQL}, y as (select distinct symbol, unnest([year(date) + 1, year(date) + 2, year(date) + 3]) as year from region_bars), s as (select symbol, min(date) as begin from region_bars group by 1)
select y.symbol, y.year, count(*) as n, min(date) as first, max(date) as last, year(any_value(begin)) <= y.year - 3 and count(*) >= 400 as eligible from y join region_bars r on r.symbol = y.symbol and year(date) between y.year - 3 and y.year - 1 join s on s.symbol = y.symbol group by 1, 2""",
    "last_bars": f"""with {REGION_SQL}, {SLOT_SQL}, a as (select * from region_bars union all select * from slot_bars), m as (select *, case when count(*) over w = 5 then avg(close) over w end as mean5, row_number() over (partition by symbol order by date desc) as k from a window w as (partition by symbol order by date rows 4 preceding))
select symbol, k, date, round(close, 6) as close, round(mean5, 6) as mean5 from m where k <= 5""",
    "common_curve": f"with {DAMPED}, {_COMMON.format('b')}, c as (select b.* from b join common using (date)), {event_sql(HYST, 1, source='c')}, {wealth_sql('0.0025')} select date, round(avg(wealth), 6) as wealth, round(avg(position), 6) as exposure from w group by 1",
    "exposure_metrics": f"""with {DAMPED}, {event_sql('case when shown <= 25 then 1 when shown >= 75 then -1 when shown is not null then 0 end', 1)}, {wealth_sql('0.0025')},
x as (select *, wealth / lag(wealth) over s - pow(1.02, (date - lag(date) over s) / 365.2425) as excess from w window s as (partition by symbol order by date))
select symbol, round(avg(excess) / stddev_samp(excess) * sqrt(252.0), 6) as sharpe, max(turnover) as turnover, min(position) as least, max(position) as most, round(avg((position < 0)::int::double), 6) as short, round(avg(position), 6) as mean from x group by 1""",
    "excess_labels": f"""with {REGION_SQL}, x as (select symbol, date, ln(lead(close, 2) over s / lead(close, 1) over s) - (lead(date, 2) over s - lead(date, 1) over s) / 365.2425 * ln(1.02::double) as excess from region_bars window s as (partition by symbol order by date)) select symbol, date, round(excess, 6) as excess from x where excess is not null""",
    "list_mismatches": """with a as (select s_suppkey as k, trim(s_name) as name, floor(s_acctbal / 10) as value from supplier where s_suppkey % 13 <> 0),
b as (select s_suppkey as k, case when s_suppkey % 7 = 0 then lower(trim(s_name)) else trim(s_name) end as name, floor(s_acctbal / 10) + (s_suppkey % 5 = 0)::int as value from supplier where s_suppkey % 11 <> 0),
r as (select coalesce(a.k, b.k) as s_suppkey, concat_ws(', ', case when b.k is null then 'not in the list' end, case when a.k is null then 'only in the list' end, case when a.name <> b.name then 'name' end, case when a.value <> b.value then 'value' end) as reasons from a full join b on a.k = b.k)
select * from r where reasons <> ''""",
}
