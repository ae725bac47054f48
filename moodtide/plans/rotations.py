"""The regions as assets of one portfolio beside bills: momentum over twelve months, wealth of rotating, equal and single holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rotation as R, schedules as H, windows as W
from ..operators.lineage import cut
from ..sources.bars import region_bars
from .schedules import BILL_SQL, observed_yields
from .trading import DAMPED, DAMPING

K = ["panel"]
ASSETS = 5
COSTS = [0.002, 0.004]


def _rows(spark, sf_dir):
    """The days on which all regions have a bar; bills grow as long as their yields are fresh, then stand."""
    bars = region_bars(spark, sf_dir).select(F.lit("regions").alias("panel"), "symbol", "date", F.pow("close", DAMPING).alias("close"))
    rows = R.common_rows(bars, K, "symbol", ASSETS)
    bills = H.segmented_cash(bars.filter("symbol = 'AFRICA'").select("panel", "date"), observed_yields(spark, sf_dir).withColumn("panel", F.lit("regions")), K, "yield").select("panel", "date", "wealth")
    known = rows.join(bills, [*K, "date"], "left")
    return known.withColumn("cash", F.coalesce(F.last("wealth", ignorenulls=True).over(W.over(K)), F.lit(1.0))).drop("wealth")


def _targets(rows):
    signals = R.momentum_targets(R.anniversaries(rows, K))
    equal = F.transform("closes", lambda x: F.lit(1.0 / ASSETS))
    monthly = signals.select(*K, "execution", F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), w.alias("weights")) for n, w in (("top1", F.col("top1")), ("top2", F.col("top2")), ("equal", equal))])).alias("t")).select(*K, "t.strategy", "execution", "t.weights")
    first = signals.groupBy(*K).agg(F.min("execution").alias("execution"), F.min_by("closes", "execution").alias("closes"))
    one = first.select(*K, "execution", "closes", F.explode(F.transform("closes", lambda x: x["asset"])).alias("held"))
    held = one.select(*K, F.concat(F.lit("hold "), "held").alias("strategy"), "execution", F.transform("closes", lambda x: F.when(x["asset"] == F.col("held"), 1.0).otherwise(0.0)).alias("weights"))
    return signals, monthly.unionByName(held)


def rotation_signals(spark, sf_dir):
    """Each month's ranking of the regions over twelve months against bills, and what would be held."""
    signals, _ = _targets(_rows(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), " ")
    return signals.select("date", "reference", "execution", F.round("cash_return", 6).alias("cash_return"), F.array_join(F.transform("ranking", lambda x: x["asset"]), ", ").alias("ranking"), text(F.col("top1")).alias("top1"), text(F.col("top2")).alias("top2"))


def _curves(spark, sf_dir):
    # signals and wealth read the rows, wealth reads the targets twice
    rows = cut(_rows(spark, sf_dir))
    return R.wealth(rows, cut(_targets(rows)[1]), K, COSTS)


def rotation_curves(spark, sf_dir):
    return _curves(spark, sf_dir).select("strategy", "cost", "date", F.round("wealth", 6).alias("wealth"), F.round("turnover", 6).alias("turnover"), "trades")


def rotation_summary(spark, sf_dir):
    out = R.summary(_curves(spark, sf_dir), [*K, "strategy", "cost"]).drop("panel")
    return out.withColumns({c: F.round(c, 6) for c in ("wealth", "growth", "volatility", "drawdown", "turnover")})


QUERIES = {f.__name__: f for f in (rotation_signals, rotation_curves, rotation_summary)}

_SIGNALS = f"""with recursive {DAMPED}, {BILL_SQL}, n as (select date from b group by 1 having count(*) = {ASSETS}), m as (select date, lead(date) over (order by date) as execution from n),
bl as (select date, coalesce(max(wealth) over (order by date), 1) as cash from (select n.date, wealth from n left join bw on bw.symbol = 'AFRICA' and bw.date = n.date)),
e as (select * from m qualify row_number() over (partition by date_trunc('month', date) order by date desc) = 1), a as (select *, (date - interval 12 month)::date as anniversary from e where execution is not null),
g as (select a.date, execution, max(n.date) as reference, anniversary from a join n on n.date <= anniversary group by 1, 2, 4 having anniversary - max(n.date) <= 7),
c as (select g.date, reference, execution, y.cash / z.cash - 1 as cash_return from g join bl y on y.date = g.date join bl z on z.date = reference),
r as (select c.*, u.symbol, u.close / v.close - 1 as rise, row_number() over (partition by c.date order by u.close / v.close desc, u.symbol) as place from c join b u on u.date = c.date join b v on v.date = reference and v.symbol = u.symbol),
t as (select *, case when place = 1 and rise > cash_return then 1.0::double else 0 end as top1, case when place <= 2 and rise > cash_return then 0.5::double else 0 end as top2 from r)"""
#: Of all ways to buy or sell each asset the one that leaves least is the consistent one.
_FRACTION = "least(" + ", ".join(
    "(1 + cost * (" + " ".join(f"{'+' if s >> k & 1 else '-'} v[{k + 1}]" for k in range(ASSETS)) + ")) / (1 + cost * (" + " ".join(f"{'+' if s >> k & 1 else '-'} w[{k + 1}]" for k in range(ASSETS)) + "))" for s in range(1 << ASSETS)
) + ")"
_DOT = lambda a, b: "(" + " + ".join(f"{a.format(k)} * {b.format(k)}" if b else a.format(k) for k in range(1, ASSETS + 1)) + ")"
_CURVES = f"""{_SIGNALS}, s as (select 'top1' as strategy, execution, list(top1 order by symbol) as w from t group by 2 union all select 'top2', execution, list(top2 order by symbol) from t group by 2 union all select 'equal', execution, list(0.2::double order by symbol) from t group by 2
  union all select 'hold ' || h.symbol, (select min(execution) from t), list((x.symbol = h.symbol)::int::double order by x.symbol) from (select distinct symbol from b) h, (select distinct symbol from b) x group by h.symbol),
p as (select n.date, cash, list(close order by symbol) as p from n join b on b.date = n.date join bl on bl.date = n.date group by 1, 2),
j as (select o.strategy, cost, p.date, p.p, cash, s.w, count(s.w) over (partition by o.strategy, cost order by p.date rows between unbounded preceding and 1 preceding) as seg, row_number() over (partition by o.strategy, cost order by p.date) as i
  from (select strategy, min(execution) as f from s group by 1) o, (values (0.002::double), (0.004::double)) x(cost), p left join s on s.strategy = o.strategy and s.execution = p.date where p.date >= f),
k as (select j.*, x.p as q, x.cash as qc, x.w as qw from j left join j x on x.strategy = j.strategy and x.cost = j.cost and x.w is not null and x.seg = j.seg - 1),
l as (select *, case when q is null then [{', '.join(['0.0::double'] * ASSETS)}] else [{', '.join(f'qw[{i}] * p[{i}] / q[{i}]' for i in range(1, ASSETS + 1))}] end as u, coalesce((1 - {_DOT('qw[{}]', '')}) * cash / qc, 1) as idle from k),
m1 as (select *, {_DOT('u[{}]', '')} + idle as total from l), m2 as (select *, [{', '.join(f'u[{i}] / total' for i in range(1, ASSETS + 1))}] as v from m1), m3 as (select *, case when w is not null then {_FRACTION} end as f from m2),
m4 as (select *, coalesce(exp(sum(case when f is not null then ln(total * f) end) over (partition by strategy, cost order by i rows between unbounded preceding and 1 preceding)), 1) * total as gross, i = max(i) over (partition by strategy, cost) as ended from m3),
m5 as (select *, gross * coalesce(f, 1) as net, case when w is null then 0 else {' + '.join(f'abs(w[{i}] * f - v[{i}])' for i in range(1, ASSETS + 1))} end as moved, case when not ended then 0 when w is null then {_DOT('v[{}]', '')} else {_DOT('w[{}]', '')} end as sold from m4),
curves as (select strategy, cost, date, net * (1 - cost * sold) as wealth, gross * moved + net * sold as turnover, (moved > 1e-14)::int + (net * sold > 1e-14)::int as trades from m5)"""
ORACLES = {
    "rotation_signals": f"""{_SIGNALS} select date, reference, execution, round(cash_return, 6) as cash_return, string_agg(symbol, ', ' order by place) as ranking, string_agg(printf('%.3f', top1), ' ' order by symbol) as top1, string_agg(printf('%.3f', top2), ' ' order by symbol) as top2 from t group by 1, 2, 3, cash_return""",
    "rotation_curves": f"{_CURVES} select strategy, cost, date, round(wealth, 6) as wealth, round(turnover, 6) as turnover, trades from curves",
    "rotation_summary": f"""{_CURVES}, z as (select *, ln(wealth / lag(wealth) over o) as r, 1 - wealth / max(wealth) over o as fall from curves window o as (partition by strategy, cost order by date)),
y as (select strategy, cost, min(date) as first, max(date) as last, count(*) as rows, max_by(wealth, date) as wealth, stddev_samp(r) as sd, max(fall) as drawdown, sum(turnover) as turnover, sum(trades) as trades, (max(date) - min(date)) / 365.2425::double as years from z group by 1, 2)
select strategy, cost, first, last, rows, round(wealth, 6) as wealth, round(drawdown, 6) as drawdown, round(turnover, 6) as turnover, trades, case when years > 0 then round(ln(wealth) / years, 6) end as growth, case when years > 0 then round(sd * sqrt((rows - 1) / years), 6) end as volatility from y""",
}
