"""Controls by schedule, and cash with changing rates, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O, schedules as H, signals as G, studies as D, windows as W
from ..operators.lineage import cut
from ..sources.bars import REGION_SQL, cents, region_bars, table
from .sentiment import rounded
from .trading import DAMPED, event_sql, scored, wealth_sql

S = ["symbol"]
POWERS, CAPS = (0.5, 1.0, 2.0), (1.0, 1.25, 1.5)
COST, SPREAD, STEPS = 0.002, 0.015, 16


def observed_yields(spark, sf_dir):
    """date, yield in percent from 0 to 5: bills' yields, from the days with orders of every third customer."""
    o = table(spark, sf_dir, "orders").filter("o_custkey % 3 = 0")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg((F.pmod(F.sum(cents(F.col("o_totalprice"))), F.lit(500)) / 100).alias("yield"))


def _bill_wealth(spark, sf_dir):
    calendar = region_bars(spark, sf_dir).select("symbol", "date")
    yields = observed_yields(spark, sf_dir).crossJoin(F.broadcast(calendar.select("symbol").distinct()))  # five regions
    return H.segmented_cash(calendar, yields, S, "yield")


def segmented_cash(spark, sf_dir):
    return rounded(_bill_wealth(spark, sf_dir), "wealth")


def absolute_momentum(spark, sf_dir):
    """At each month's end in the market if the close is above that of twelve months' ends before, else in bills at the yields of the day; the order is carried out at the next close, and sold at the end."""
    bars = scored(spark, sf_dir).withColumn("execution", F.lead("date").over(W.series(S)))
    ends = bars.withColumn("k", F.row_number().over(W.Window.partitionBy("symbol", F.trunc("date", "month")).orderBy(F.desc("date")))).filter("k = 1")
    orders = ends.withColumn("before", F.lag("close", 12).over(W.series(S))).filter("before is not null and execution is not null").select("symbol", "execution", (F.col("close") > F.col("before")).cast("double").alias("target"))
    cash = _bill_wealth(spark, sf_dir).select("symbol", "date", F.col("wealth").alias("bills"))
    rows = G.as_of_target(bars.select("symbol", "date", "close"), orders, S).filter("target is not null").join(cash, ["symbol", "date"])
    w = W.series(S)
    held = F.lag("target").over(w)
    growth = lambda c: F.col(c) / F.lag(c).over(w)
    # where no yield is fresh enough, cash earns nothing
    grown = F.coalesce(F.when(held == 1, growth("close")).otherwise(growth("bills")), F.lit(1.0))
    traded = F.abs(F.col("target") - F.coalesce(held, F.lit(0.0)))
    step = rows.select("symbol", "date", "target", (F.log(grown) + traded * F.log(F.lit(0.9975))).alias("g"), traded.alias("traded"))
    out = step.groupBy("symbol").agg(F.sum("g").alias("g"), F.sum("traded").alias("changes"), F.max_by("target", "date").alias("last"), F.count("*").alias("bars"))
    return rounded(out.select("symbol", F.exp(F.col("g") + F.col("last") * F.log(F.lit(0.9975))).alias("wealth"), (F.col("changes") + F.col("last")).alias("changes"), "bars"), "wealth")


def _schedules(spark, sf_dir):
    bars = scored(spark, sf_dir).select("symbol", "date", "close")
    states = O.monthly_variance(bars.withColumn("r", W.log_return(F.col("close"), S)), S).select("symbol", "month", "ratio")
    power, cap = F.array(*map(F.lit, POWERS)), F.array(*map(F.lit, CAPS))
    grid = states.withColumn("power", F.explode(power)).withColumn("cap", F.explode(cap))
    return bars, D.banded_schedule(grid, [*S, "power", "cap"], F.col("power"), F.col("cap"))


def schedule_controls(spark, sf_dir):
    """Nine volatility schedules a region, each against the constant exposure that comes nearest to its volatility when restored on the same days."""
    bars, schedule = _schedules(spark, sf_dir)
    keys = [*S, "power", "cap"]
    cash = F.pow(F.lit(1.02), F.datediff("date", F.lit("1970-01-01").cast("date")) / 365.2425)
    # both are read several times
    bars = cut(bars)
    events = cut(H.executions(schedule.select(*keys, "month", F.round("target", 9).alias("target")), bars, keys, S))
    targets = F.transform(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: k * 0.1)
    done = H.matched_controls(events, bars.withColumn("cash", cash), keys, S, targets, COST, SPREAD)
    return rounded(done.drop("gap"), "own", "target", "control")


QUERIES = {f.__name__: f for f in (segmented_cash, absolute_momentum, schedule_controls)}

_YIELDS = "ys as (select o_orderdate::date as date, (sum(round(o_totalprice * 100)::bigint) % 500)::double / 100 as p from orders where o_custkey % 3 = 0 group by 1)"
#: One row per day, each with the yield last seen at its beginning.
BILL_SQL = f"""{_YIELDS}, sp as (select symbol, min(date) as f, max(date) as l from region_bars group by 1), dy as (select symbol, unnest(generate_series(f, l - 1, interval 1 day))::date as day from sp),
kn as (select dy.symbol, dy.day, ys.date as seen, ys.p from dy asof left join ys on dy.day >= ys.date), ok as (select *, seen is not null and day + 1 - seen <= 7 as good from kn),
cu as (select symbol, day + 1 as date, sum(case when good then ln(1 / (1 - p / 100 * 91 / 360)) / 91 else 0 end) over w as g, min(case when not good then day + 1 end) over w as bad from ok window w as (partition by symbol order by day)),
bw as (select r.symbol, r.date, case when bad is null then exp(coalesce(g, 0)) end as wealth, bad from region_bars r left join cu on r.symbol = cu.symbol and r.date = cu.date)"""
_STATES = """rr as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from {0}), mv as (select symbol, date_trunc('month', date)::date as month, avg(r * r) as v from rr where r is not null group by 1, 2 having count(*) >= 15),
ra as (select a.symbol, a.month, case when count(b.v) = 12 then median(b.v) end / any_value(a.v) as ratio from mv a left join mv b on a.symbol = b.symbol and b.month < a.month and b.month >= a.month - interval 12 month group by 1, 2)"""
_ASKED = """ak as materialized (select *, row_number() over (partition by symbol, power, cap order by month) as k from (select symbol, month, ratio, power, cap, least(cap, greatest(0.5, pow(ratio, power))) as asked from ra, (values {0}) pv(power), (values {1}) cv(cap) where ratio is not null)),
sc as (select symbol, power, cap, k, month, ratio, asked, asked as target from ak where k = 1
  union all select n.symbol, n.power, n.cap, n.k, n.month, n.ratio, n.asked, case when abs(n.asked - s.target) >= 0.10 - 16 * 2.220446049250313e-16 then n.asked else s.target end from sc s join ak n on n.symbol = s.symbol and n.power = s.power and n.cap = s.cap and n.k = s.k + 1)"""
_values = lambda xs: ", ".join(f"({x}::double)" for x in xs)


def _path_sql(source: str, keys: str, name: str) -> str:
    w = f"partition by {keys} order by date"
    part = lambda price, cash, owed: f"x1 * {price} / p1 + (1 - x1) * case when x1 > 1 then {owed} / l1 else {cash} / c1 end"
    return f"""{name}0 as (select *, cash * exp({SPREAD} * (date - date '1970-01-01') / 365.2425) as owed from {source}),
{name}1 as (select *, last_value(target ignore nulls) over (w rows unbounded preceding) as x, last_value(case when target is not null then close end ignore nulls) over (w rows unbounded preceding) as p,
  last_value(case when target is not null then cash end ignore nulls) over (w rows unbounded preceding) as c, last_value(case when target is not null then owed end ignore nulls) over (w rows unbounded preceding) as l from {name}0 window w as ({w})),
{name}2 as (select *, lag(x) over w as x1, lag(p) over w as p1, lag(c) over w as c1, lag(l) over w as l1, lag(close) over w as close1, lag(cash) over w as cash1, lag(owed) over w as owed1, lead(date) over w is null as fin from {name}1 window w as ({w})),
{name}3 as (select *, {part('close', 'cash', 'owed')} as now, {part('close1', 'cash1', 'owed1')} as before, x1 * close / p1 / ({part('close', 'cash', 'owed')}) as r from {name}2),
{name}4 as (select *, ln(now / before * case when target > r then (1 + {COST} * r) / (1 + {COST} * target) when target < r then (1 - {COST} * r) / (1 - {COST} * target) else 1 end * case when fin then 1 - {COST} * coalesce(target, r) else 1 end) as g from {name}3),
{name} as materialized (select {keys}, stddev_samp(g) * sqrt(count(g) / ((max(date) - min(date)) / 365.2425)) as vol from {name}4 group by all having min(coalesce(now, 1)) > 0)"""


def _leveraged_sql(cost: float, borrow: float, floor: float | None = None) -> str:
    """The path of `lv` (bars with targets) stepped through bar by bar: what a decision of the bar before does at a bar's close."""
    margin = f"r1 > 0 and w / r1 < {floor}" if floor is not None else "false"
    after = f"target0 * (w + sgn * {cost} * r1) / (1 + sgn * target0 * {cost})"
    case = lambda over, gone, sold, traded, kept: f"case when over_ then {over} when w <= 0 then {gone} when {margin} then {sold} when target0 is not null and abs(target0 * w - r1) > 1e-14 * w then {traded} else {kept} end"
    return f"""lb as materialized (select symbol, i, date, close, lag(close) over s as close0, lag(target) over s as target0, (date - lag(date) over s) / 365.2425 as years from lv window s as (partition by symbol order by i)),
lf as (select symbol, i, 1.0::double as risk, 0.0::double as idle, false as over_, 0.0::double as moved, 0.0::double as paid from lb where i = 0
  union all select symbol, i, {case('risk', '0', '0', after, 'r1')}, {case('idle', '0', f'w - {cost} * r1', f'w - {cost} * abs({after} - r1) - {after}', 'grown')}, over_ or w <= 0 or ({margin}),
    moved + {case('0', '0', '0', f'abs({after} - r1)', '0')}, paid + case when over_ then 0 else greatest(0, idle - grown) end
  from (select *, r1 + grown as w, case when target0 * (r1 + grown) > r1 then 1 else -1 end as sgn from (select x.symbol, x.i, x.target0, f.risk, f.idle, f.over_, f.moved, f.paid, f.risk * x.close / x.close0 as r1, f.idle * exp(case when f.idle < 0 then {borrow} else 0 end * x.years) as grown
    from lf f join lb x on x.symbol = f.symbol and x.i = f.i + 1)))
select symbol, date, round(risk + idle, 6) as wealth, round(case when risk + idle > 0 then risk / (risk + idle) else 0 end, 6) as exposure, round(moved, 6) as traded, round(paid, 6) as financing from lf join lb using (symbol, i)"""


_DAMPED = f"{REGION_SQL}, db as materialized (select symbol, date, pow(close, 0.025) as close, pow(1.02, (date - date '1970-01-01') / 365.2425) as cash from region_bars)"
ORACLES = {
    "segmented_cash": f"""with {REGION_SQL}, {BILL_SQL}, pts as (select symbol, date from region_bars union select symbol, ys.date from ys, sp where ys.date > f and ys.date < l),
sg as (select r.symbol, r.date, lag(r.date) over (partition by r.symbol order by r.date) as before from region_bars r), sn as (select sg.symbol, sg.date, count(p.date) as segments from sg left join pts p on p.symbol = sg.symbol and p.date >= sg.before and p.date < sg.date group by 1, 2)
select symbol, date, round(wealth, 6) as wealth, bad as refused, segments from bw join sn using (symbol, date)""",
    "absolute_momentum": f"""with {_DAMPED}, {BILL_SQL}, x as (select *, lead(date) over (partition by symbol order by date) as execution from db), e as (select * from x qualify row_number() over (partition by symbol, date_trunc('month', date) order by date desc) = 1),
m as (select *, lag(close, 12) over (partition by symbol order by date) as before from e), o as (select symbol, execution as date, (close > before)::int as t from m where before is not null and execution is not null),
r as (select b.symbol, b.date, b.close, bw.wealth, last_value(t ignore nulls) over (partition by b.symbol order by b.date) as target from db b left join o on b.symbol = o.symbol and b.date = o.date join bw on bw.symbol = b.symbol and bw.date = b.date),
h as (select *, lag(target) over s as held, close / lag(close) over s as up, wealth / lag(wealth) over s as cash from r where target is not null window s as (partition by symbol order by date)),
g as (select symbol, date, target, abs(target - coalesce(held, 0)) as traded, ln(coalesce(case when held = 1 then up else cash end, 1)) as g from h)
select symbol, round(exp(sum(g) + (sum(traded) + max_by(target, date)) * ln(0.9975::double)), 6) as wealth, sum(traded) + max_by(target, date) as changes, count(*) as bars from g group by 1""",
    "volatility_schedule": f"with recursive {REGION_SQL}, {_STATES.format('region_bars')}, {_ASKED.format('(0.5::double)', '(1.5::double)')} select symbol, month, round(ratio, 6) as ratio, round(asked, 6) as asked, round(target, 6) as target from sc",
    "schedule_controls": f"""with recursive {_DAMPED}, {_STATES.format('db')}, {_ASKED.format(_values(POWERS), _values(CAPS))},
ch as (select symbol, power, cap, month, round(target, 9) as target from sc qualify round(target, 9) is distinct from lag(round(target, 9)) over (partition by symbol, power, cap order by month)),
fb as (select symbol, date_trunc('month', date)::date as month, min(date) as date from db group by 1, 2), ex as materialized (select symbol, power, cap, fb.date, target from ch join fb using (symbol) where fb.month = ch.month + interval 1 month),
sg as materialized (select symbol, power, cap, string_agg(date::varchar, '|' order by date) as days, count(*) as events, min(date) as start from ex group by 1, 2, 3),
ow as (select db.*, s.power, s.cap, ex.target from sg s join db on db.symbol = s.symbol and db.date >= s.start left join ex on ex.symbol = s.symbol and ex.power = s.power and ex.cap = s.cap and ex.date = db.date), {_path_sql('ow', 'symbol, power, cap', 'own')},
dg as (select symbol, days, min(start) as start, count(*) as sharing from sg group by 1, 2), gr as (select db.*, d.days, k * 0.1::double as grid, case when contains(d.days, db.date::varchar) then k * 0.1::double end as target from dg d join db on db.symbol = d.symbol and db.date >= d.start, range({STEPS}) t(k)), {_path_sql('gr', 'symbol, days, grid', 'ctl')},
bt as (select s.symbol, s.power, s.cap, s.events, s.days, own.vol as own, ctl.grid, ctl.vol as control from sg s join own using (symbol, power, cap) join ctl on ctl.symbol = s.symbol and ctl.days = s.days qualify row_number() over (partition by s.symbol, s.power, s.cap order by round(abs(ctl.vol - own.vol), 10), ctl.grid) = 1)
select b.symbol, power, cap, events, sharing, (select count(*) from ctl where ctl.symbol = b.symbol and ctl.days = b.days) as simulations, round(own, 6) as own, round(grid, 6) as target, round(control, 6) as control from bt b join dg on dg.symbol = b.symbol and dg.days = b.days""",
    "sentiment_overlay": f"with recursive {DAMPED}, lv as (select *, case when score <= 24 then 1.5 when score >= 75 then 0.5 when score is not null then 1.0 end as target from b), {_leveraged_sql(0.005, 0.05)}",
    "volatility_managed": f"""with recursive {DAMPED}, {_STATES.format('b')}, {_ASKED.format('(0.5::double)', '(1.5::double)')},
lv as (select b.*, case when b.date = max(b.date) over (partition by b.symbol, date_trunc('month', b.date)) then sc.target end as target from b left join sc on sc.symbol = b.symbol and sc.month = date_trunc('month', b.date)), {_leveraged_sql(0.002, 0.015, 0.4)}""",
    "switched_rule": f"""with {DAMPED}, g as (select b.*, fear, greed from b, (values (15), (20), (25)) f(fear), (values (70), (75), (80)) h(greed)), {event_sql('case when shown >= greed then 0 when shown <= fear then 1 end', 1, name='gp', source='g', key='symbol, fear, greed')}, {wealth_sql('0.0025', source='gp', name='gw', key='symbol, fear, greed')},
y as (select symbol, fear, greed, year(date) as year, round(sum(ln(growth)), 6) as g from gw group by 1, 2, 3, 4), t as (select y.year + k as year, fear, greed, avg(g) as mean, count(distinct y.year) as years from y, range(1, 4) r(k) group by 1, 2, 3),
aw as (select year, fear, greed from t where years = 3 qualify row_number() over (partition by year order by mean desc, fear, greed) = 1), sw as (select b.*, aw.fear, aw.greed from b left join aw on aw.year = year(b.date)),
{event_sql('case when shown >= greed then 0 when shown <= fear then 1 end', 1, source='sw')}, {wealth_sql('0.0025')} select symbol, date, position, round(wealth, 6) as wealth from w""",
}
