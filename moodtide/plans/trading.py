"""Positions, wealth, grids and placebos over the regions' momentum scores. Closes are damped to the fortieth root, since the
test data's mean prices jump from day to day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O, positions as P, windows as W
from .outcomes import SCORE_SQL, momentum_scores
from .sentiment import rounded

S = ["symbol"]
DAMPING = 0.025


def scored(spark, sf_dir):
    return momentum_scores(spark, sf_dir).withColumn("close", F.pow("close", DAMPING))


DAMPED = SCORE_SQL + """, b as (select symbol, date, pow(close, 0.025) as close, score, floor(floor(score * 10 + 0.5) / 10 + 0.5)::int as shown, i, n from steps)"""


def _terminal(df, keys):
    return df.groupBy(*keys).agg(F.max_by("wealth", "date").alias("wealth"), F.max("turnover").alias("turnover"))


def hysteresis(spark, sf_dir):
    p = P.hysteresis(scored(spark, sf_dir), S, 25, 75, 1, 5)
    return rounded(P.wealth(p, S, 0.0025).select("symbol", "date", "position", "wealth", "turnover"), "wealth")


def month_end_hysteresis(spark, sf_dir):
    return P.month_end_hysteresis(scored(spark, sf_dir), S, 35, 65).select("symbol", "date", "position")


def long_short(spark, sf_dir):
    p = P.long_short(scored(spark, sf_dir), S, 25, 75, False)
    return rounded(P.wealth(p, S, 0.0025, 0.05 / 252).select("symbol", "date", "position", "wealth"), "wealth")


def above_level(spark, sf_dir):
    return P.above_level(scored(spark, sf_dir), S, 50).select("symbol", "date", "position")


def above_own_mean(spark, sf_dir):
    return P.above_own_mean(scored(spark, sf_dir), S, 63).select("symbol", "date", "position")


def trading_cycles(spark, sf_dir):
    return rounded(P.cycles(P.hysteresis(scored(spark, sf_dir), S, 25, 75), S), "invested")


def fear_then_time(spark, sf_dir):
    p = P.fear_then_time(scored(spark, sf_dir), S, 20, 21)
    return rounded(P.wealth(p, S, 0.0025).select("symbol", "date", "position", "wealth"), "wealth")


def continuous_exposure(spark, sf_dir):
    return rounded(P.continuous(scored(spark, sf_dir), S, True).select("symbol", "date", "position"), "position")


def armed_trend(spark, sf_dir):
    trend = scored(spark, sf_dir).withColumn("trend_up", F.coalesce(F.col("close") > W.full_mean(F.col("close"), S, 200), F.lit(False)))
    return P.armed_trend(trend, S, 25, 75).select("symbol", "date", "position")


def month_mean_wealth(spark, sf_dir):
    """The ten-month rule under a grid of costs."""
    bars = scored(spark, sf_dir)
    orders = O.month_mean_orders(bars.select("symbol", "date", "close"), S).select("symbol", "date", "target")
    costs = spark.sql("select explode(array(0.0D, 0.0025D, 0.005D, 0.01D)) as cost")
    rows = P.last_event(bars.join(orders, ["symbol", "date"], "left"), S, F.col("target"), 1).crossJoin(F.broadcast(costs))
    return rounded(_terminal(P.wealth(rows, ["symbol", "cost"], F.col("cost")), ["symbol", "cost"]), "wealth")


def threshold_grid(spark, sf_dir):
    """All pairs of thresholds on all regions, ranked by their mean gain over holding; ties by declaration."""
    grid = spark.sql("select explode(array(15, 20, 25)) as fear").crossJoin(spark.sql("select explode(array(70, 75, 80)) as greed"))
    bars = scored(spark, sf_dir)
    rows = P.hysteresis(bars.crossJoin(F.broadcast(grid)), ["symbol", "fear", "greed"], F.col("fear"), F.col("greed"))
    done = _terminal(P.wealth(rows, ["symbol", "fear", "greed"], 0.0025), ["symbol", "fear", "greed"])
    hold = bars.groupBy("symbol").agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("hold"))
    gain = done.join(hold, "symbol").groupBy("fear", "greed").agg(F.round(F.avg(F.log(F.col("wealth") / F.col("hold"))), 6).alias("mean_gain"), F.count(F.when(F.col("wealth") > F.col("hold"), 1)).alias("wins"))
    rank = F.row_number().over(W.Window.orderBy(F.desc("mean_gain"), "fear", "greed"))  # one row per candidate
    return gain.withColumn("rank", rank)


def timing_placebo(spark, sf_dir):
    """The terminal wealth of a rule against those of the same rule on scores moved round by nine offsets."""
    bars = scored(spark, sf_dir)
    actual = _terminal(P.wealth(P.hysteresis(bars, S, 25, 75), S, 0.0025), S)
    keys = ["symbol", "k"]
    moved = O.rotated(bars.crossJoin(F.broadcast(spark.range(1, 10).withColumnRenamed("id", "k"))), keys, "score", F.floor(F.col("k") * F.count("*").over(W.Window.partitionBy(*keys)) / 10))
    shifted = _terminal(P.wealth(P.hysteresis(moved.withColumn("score", F.col("score_rotated")), keys, 25, 75), keys, 0.0025), keys)
    return rounded(P.placebo(actual, shifted, S, "wealth"), "actual", "median", "best", "percentile", "p")


QUERIES = {f.__name__: f for f in (hysteresis, month_end_hysteresis, long_short, above_level, above_own_mean, trading_cycles, fear_then_time, continuous_exposure, armed_trend, month_mean_wealth, threshold_grid, timing_placebo)}


def event_sql(event: str, initial: int, name: str = "p", source: str = "b", key: str = "symbol") -> str:
    return f"{name}e as (select *, {event} as ev from {source}), {name} as (select *, coalesce(last_value(ev ignore nulls) over (partition by {key} order by date rows between unbounded preceding and 1 preceding), {initial})::double as position from {name}e)"


def wealth_sql(cost: str, borrow: str = "0", source: str = "p", name: str = "w", key: str = "symbol") -> str:
    return f"""{name}0 as (select *, lag(position) over (partition by {key} order by date) as held, close / lag(close) over (partition by {key} order by date) - 1 as move from {source}),
{name}1 as (select *, abs(position - coalesce(held, position)) as change, coalesce(1 + held * move - case when held < 0 then -held * {borrow} else 0 end, 1) * (1 - {cost} * abs(position - coalesce(held, position))) as growth from {name}0),
{name} as (select *, exp(sum(ln(growth)) over (partition by {key} order by date)) as wealth, sum(change) over (partition by {key} order by date) as turnover from {name}1)"""


def fold_sql(state: str, first: str, then: str, source: str = "b", name: str = "fold") -> str:
    """A rule stepped through bar by bar: r.* is the state that the bar x finds. state: column names, first: their values on bar 0."""
    return f"{name}_bars as materialized (select * from {source}), {name} as (select symbol, i, {first} from {name}_bars where i = 0 union all select x.symbol, x.i + 1, {then} from {name} r join {name}_bars x on x.symbol = r.symbol and x.i = r.i), p as (select q.*, {state} from {name}_bars q join {name} r on q.symbol = r.symbol and q.i = r.i)"


HYST = "case when shown >= 75 then 0 when shown <= 25 then 1 end"
ORACLES = {
    "hysteresis": f"with {DAMPED}, {event_sql('case when i % 5 = 0 and shown >= 75 then 0 when i % 5 = 0 and shown <= 25 then 1 end', 1)}, {wealth_sql('0.0025')} select symbol, date, position, round(wealth, 6) as wealth, turnover from w",
    "month_end_hysteresis": f"with {DAMPED}, e as (select *, date_trunc('month', lead(date) over (partition by symbol order by date)) <> date_trunc('month', date) as last from b), {event_sql('case when last and shown >= 65 then 0 when last and shown <= 35 then 1 end', 1, source='e')} select symbol, date, position from p",
    "long_short": f"with {DAMPED}, {event_sql('case when shown <= 25 then 1 when shown >= 75 then -1 when shown is not null then 0 end', 1)}, {wealth_sql('0.0025', '0.05 / 252')} select symbol, date, position, round(wealth, 6) as wealth from w",
    "above_level": f"with {DAMPED}, {event_sql('case when shown is not null then (shown >= 50)::int end', 1)} select symbol, date, position from p",
    "above_own_mean": f"with {DAMPED}, m as (select symbol, date, case when count(*) over w = 63 then avg(score) over w end as mean from b where score is not null window w as (partition by symbol order by date rows 62 preceding)), j as (select b.*, mean from b left join m using (symbol, date)), {event_sql('case when mean is not null then (score > mean)::int end', 1, source='j')} select symbol, date, position from p",
    "trading_cycles": f"""with {DAMPED}, {event_sql(HYST, 1)}, q as (select *, lag(position) over (partition by symbol order by date) as before, i - row_number() over (partition by symbol, position order by date) as run from p), r as (select symbol, position, run, count(*) as k from q group by 1, 2, 3),
l as (select symbol, coalesce(max(k) filter (position = 1), 0) as longest_in, coalesce(max(k) filter (position = 0), 0) as longest_out from r group by 1)
select symbol, count(*) filter (position > before) as buys, count(*) filter (position < before) as sells, round(avg(position), 6) as invested, any_value(longest_in) as longest_in, any_value(longest_out) as longest_out from q join l using (symbol) group by symbol""",
    "fear_then_time": f"with recursive {DAMPED}, {fold_sql('(r.lft > 0)::int::double as position', '0 as lft', 'case when lft > 0 then lft - 1 when shown <= 20 then 21 else 0 end')}, {wealth_sql('0.0025')} select symbol, date, position, round(wealth, 6) as wealth from w",
    "continuous_exposure": f"with recursive {DAMPED}, {fold_sql('r.pos as position', '1.0::double as pos', 'case when abs((100 - score) / 100 - pos) > 0.10 then (100 - score) / 100 else pos end')} select symbol, date, round(position, 6) as position from p",
    "armed_trend": f"""with recursive {DAMPED}, t as (select *, coalesce(close > case when count(*) over m = 200 then avg(close) over m end, false) as up from b window m as (partition by symbol order by date rows 199 preceding)),
{fold_sql('r.pos as position', '1.0::double as pos, null::date as armed', 'case when shown >= 75 then 0 when shown > 25 and x.date - armed > 90 then pos when (shown <= 25 or armed is not null) and up then 1 else pos end, case when shown >= 75 then null when shown <= 25 and not (up and pos = 0) then x.date when shown > 25 and x.date - armed > 90 or up and pos = 0 then null else armed end', source='t')} select symbol, date, position from p""",
    "month_mean_wealth": f"""with {DAMPED}, x as (select *, lead(date) over (partition by symbol order by date) as execution from b), e as (select * from x qualify row_number() over (partition by symbol, date_trunc('month', date) order by date desc) = 1),
m as (select *, case when count(*) over w = 10 then avg(close) over w end as mean from e window w as (partition by symbol order by date rows 9 preceding)), o as (select symbol, date, (close > mean)::int as target from m where mean is not null and execution is not null),
j as (select b.*, target from b left join o using (symbol, date)), {event_sql('target', 1, source='j')}, c as (select p.*, cost from p, (values (0.0::double), (0.0025::double), (0.005::double), (0.01::double)) v(cost)), {wealth_sql('cost', source='c', key='symbol, cost')}
select symbol, cost, round(max_by(wealth, date), 6) as wealth, max(turnover) as turnover from w group by 1, 2""",
    "threshold_grid": f"""with {DAMPED}, g as (select b.*, fear, greed from b, (values (15), (20), (25)) f(fear), (values (70), (75), (80)) h(greed)), {event_sql('case when shown >= greed then 0 when shown <= fear then 1 end', 1, source='g', key='symbol, fear, greed')}, {wealth_sql('0.0025', key='symbol, fear, greed')},
t as (select symbol, fear, greed, max_by(wealth, date) as wealth from w group by 1, 2, 3), h as (select symbol, max_by(close, date) / min_by(close, date) as hold from b group by 1),
r as (select fear, greed, round(avg(ln(wealth / hold)), 6) as mean_gain, count(*) filter (wealth > hold) as wins from t join h using (symbol) group by 1, 2) select *, row_number() over (order by mean_gain desc, fear, greed) as rank from r""",
    "timing_placebo": f"""with {DAMPED}, {event_sql(HYST, 1)}, {wealth_sql('0.0025')}, a as (select symbol, max_by(wealth, date) as actual from w group by 1),
m as (select b.symbol, k, b.date, b.close, o.shown from b, (select unnest(range(1, 10)) as k) ks, b o where o.symbol = b.symbol and b.i = (o.i + floor(k * o.n / 10)::bigint) % o.n),
{event_sql(HYST, 1, name='pp', source='m', key='symbol, k')}, {wealth_sql('0.0025', source='pp', name='ww', key='symbol, k')}, s as (select symbol, k, max_by(wealth, date) as wealth from ww group by 1, 2)
select symbol, round(actual, 6) as actual, count(*) as shifts, round(median(wealth), 6) as median, round(max(wealth), 6) as best, round((count(*) filter (wealth < actual) + 0.5 * count(*) filter (wealth = actual)) / count(*), 6) as percentile, round((1 + count(*) filter (wealth >= actual)) / (1 + count(*))::double, 6) as p from s join a using (symbol) group by symbol, actual""",
}
