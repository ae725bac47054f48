"""Study designs over the regions' scores, and reconciliation of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O, positions as P, studies as D, windows as W
from ..sources.bars import REGION_SQL, SLOT_SQL, cents, region_bars, slot_bars, table
from .forecasts import learner_rows
from .outcomes import SCORE_SQL, momentum_scores
from .sentiment import rounded
from .statistics import OBS_SQL, observations
from .trading import DAMPED, event_sql, scored, wealth_sql

S = ["symbol"]


def event_study(spark, sf_dir):
    return rounded(D.event_study(observations(spark, sf_dir), S, {5: "fwd_5", 21: "fwd_21", 63: "fwd_63"}), "mean", "share_up", "gap")


def non_overlapping(spark, sf_dir):
    bars, w = region_bars(spark, sf_dir), W.series(S)
    rows = bars.select("symbol", F.lead("date", 1).over(w).alias("entry"), F.lead("date", 22).over(w).alias("exit")).filter("exit is not null")
    return D.non_overlapping(rows, S)


def walk_forward(spark, sf_dir):
    """The next log return on five price features, refitted every 21 rows."""
    rows = learner_rows(spark, sf_dir).select("symbol", "date", "log1", "log5", "log20", "vol20", "trend", "label")
    return rounded(D.walk_forward(rows, S, ["log1", "log5", "log20", "vol20", "trend"], "label", 756), "label", "forecast")


def walk_forward_line(spark, sf_dir):
    """The same on the last log return alone."""
    rows = learner_rows(spark, sf_dir).select("symbol", "date", "log1", "label")
    return rounded(D.walk_forward(rows, S, ["log1"], "label", 504), "label", "forecast")


def cash_wealth(spark, sf_dir):
    yields = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.pmod(F.sum(cents(F.col("o_totalprice"))), F.lit(500)) / 100).alias("yield"))
    return rounded(D.cash_wealth(region_bars(spark, sf_dir), yields, S, "yield"), "wealth")


def volatility_schedule(spark, sf_dir):
    """Monthly targets from the variance ratio, with a band within which they stay."""
    states = O.monthly_variance(region_bars(spark, sf_dir).withColumn("r", W.log_return(F.col("close"), S)), S)
    return rounded(D.banded_schedule(states.select("symbol", "month", "ratio"), S, 0.5, 1.5), "ratio", "asked", "target")


def fragility(spark, sf_dir):
    """Of the regions' scores on dates that all have."""
    wide = momentum_scores(spark, sf_dir).groupBy("date").pivot("symbol", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]).agg(F.first("score")).toDF("date", "a", "b", "c", "d", "e").dropna().withColumn("k", F.lit("world"))
    return rounded(D.fragility(wide, ["k"], ["a", "b", "c", "d", "e"]).filter("fragility is not null"), "fragility")


def month_pairs(spark, sf_dir):
    """A rule's wealth against holding, month by month."""
    bars = scored(spark, sf_dir)
    rule = P.wealth(P.hysteresis(bars, S, 25, 75), S, 0.0025).select("symbol", "date", "wealth")
    hold = bars.select("symbol", "date", (F.col("close") / F.first("close").over(W.series(S))).alias("wealth"))
    pairs = rounded(D.month_pairs(rule, hold, S), "gx", "gy", "difference")
    return pairs.withColumn("difference", F.when(F.abs("difference") < 1e-6, 0.0).otherwise(F.col("difference")))


def constant_mix(spark, sf_dir):
    """Half invested, rebalanced daily, against holding: terminal wealth and volatility."""
    bars = scored(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(W.series(S)) - 1)
    half = bars.groupBy("symbol").agg(F.exp(F.sum(F.log1p(0.5 * F.col("r")))).alias("mixed"), F.exp(F.sum(F.log1p("r"))).alias("held"), F.stddev_samp(0.5 * F.col("r")).alias("sd"))
    return rounded(half, "mixed", "held", "sd")


def matched_volatility(spark, sf_dir):
    """The weight on a grid of 0.001 whose constant mix comes nearest to the volatility of a rule; ties to the lower."""
    bars = scored(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(W.series(S)) - 1)
    rule = P.wealth(P.hysteresis(bars, S, 25, 75), S).groupBy("symbol").agg(F.stddev_samp(F.col("growth")).alias("rule"), F.stddev_samp("r").alias("full"))
    grid = rule.crossJoin(F.broadcast(spark.range(1001).select((F.col("id") / 1000).alias("weight"))))
    best = grid.groupBy("symbol").agg(F.min_by("weight", F.struct(F.round(F.abs(F.col("weight") * F.col("full") - F.col("rule")), 12), "weight")).alias("weight"))
    return best


def rebased_vintage(spark, sf_dir):
    """Slot bars up to 1999 as the old vintage, and all of them doubled as the new one."""
    bars = slot_bars(spark, sf_dir)
    return rounded(D.rebased(bars.filter("date < '2000-01-01'"), bars.withColumn("close", 2 * F.col("close")), S), "close")


def auction_windows(spark, sf_dir):
    """The growth of cash between an order's date and 91 days later against its own price's, by priority."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.lit("all").alias("k"), F.to_date("o_orderdate").alias("issue"), F.date_add(F.to_date("o_orderdate"), 91).alias("maturity"), (1 + F.col("o_orderkey") % 100 / 10000).alias("own"))
    daily = table(spark, sf_dir, "orders").select(F.lit("all").alias("k"), F.to_date("o_orderdate").alias("date")).distinct().withColumn("v", 1 + F.datediff("date", F.lit("1990-01-01").cast("date")) / 100000)
    done = D.windows_against(orders, daily, ["k"], "issue", "maturity", "v")
    return rounded(D.error_summary(done, ["o_orderpriority"], F.col("growth") - (F.col("own") - 1)), "mean", "mae", "rmse", "p50", "p90", "p99", "worst")


def excluded_windows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("A").alias("symbol"), F.to_date("o_orderdate").alias("issue"), F.date_add(F.to_date("o_orderdate"), 91).alias("maturity"))
    bars = slot_bars(spark, sf_dir).filter("symbol = 'A'").withColumn("close", F.col("close"))
    return D.windows_against(orders, bars, S, "issue", "maturity", "close").groupBy(F.coalesce("reason", F.lit("told")).alias("reason")).agg(F.count("*").alias("n"))


def upserted(spark, sf_dir):
    """Customers' first orders as saved and their last as live versions of a row."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("digest"), F.col("o_orderdate").alias("modified"), "o_orderkey")
    pick = lambda f: o.groupBy("o_custkey").agg(f("digest", "o_orderkey").alias("digest"), f("modified", "o_orderkey").alias("modified"))
    saved = pick(F.min_by).filter("o_custkey % 3 != 0").withColumn("revision", F.lit(0))
    return D.upserted(saved, pick(F.max_by), ["o_custkey"], "digest", "modified").select("o_custkey", "digest", F.to_date("modified").alias("modified"), "revision")


def expected_days(spark, sf_dir):
    return D.expected_days(region_bars(spark, sf_dir), "2001-12-31", S)


def gates(spark, sf_dir):
    """Conditions on a rule per region."""
    bars = scored(spark, sf_dir)
    done = P.wealth(P.hysteresis(bars, S, 25, 75), S, 0.0025)
    metrics = done.groupBy("symbol").agg(F.max_by("wealth", "date").alias("wealth"), F.max("turnover").alias("turnover"), F.avg("position").alias("invested"), (F.max_by("close", "date") / F.min_by("close", "date")).alias("hold"), F.min(F.col("wealth")).alias("low"))
    return D.gates(metrics, {"beats_holding": F.col("wealth") > F.col("hold"), "trades": F.col("turnover") >= 10, "mostly_in": F.col("invested") > 0.5, "never_halved": F.col("low") > 0.5}, S)


def annual_winners(spark, sf_dir):
    """Thresholds chosen each year by their growth in the three years before it, over all regions."""
    grid = spark.sql("select explode(array(15, 20, 25)) as fear").crossJoin(spark.sql("select explode(array(70, 75, 80)) as greed"))
    keys = ["symbol", "fear", "greed"]
    rows = P.wealth(P.hysteresis(scored(spark, sf_dir).crossJoin(F.broadcast(grid)), keys, F.col("fear"), F.col("greed")), keys, 0.0025)
    yearly = rows.groupBy(*keys, F.year("date").alias("year")).agg(F.round(F.sum(F.log("growth")), 6).alias("g"))
    return rounded(D.annual_winners(yearly, S, "year", "g", ["fear", "greed"]).select("year", "fear", "greed", "mean"), "mean")


def common_dates(spark, sf_dir):
    """Dates that all regions have: how many, first, last, years."""
    from ..functions.numbers import years_between

    bars = region_bars(spark, sf_dir)
    n = bars.select(F.countDistinct("symbol").alias("m"))
    days = bars.groupBy("date").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).filter("n = m")
    return days.agg(F.count("*").alias("days"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(years_between(F.min("date"), F.max("date")), 6).alias("years"))


def peer_gaps(spark, sf_dir):
    """Dates that a region lacks: shared by all its peers, by some, or its own only."""
    bars = region_bars(spark, sf_dir).select("symbol", "date")
    days = slot_bars(spark, sf_dir).select("date").distinct()
    names = bars.select("symbol").distinct()
    lacking = days.crossJoin(names).join(bars, ["symbol", "date"], "left_anti")
    peers = bars.groupBy("date").agg(F.count("*").alias("have"))
    kind = F.when(F.col("have").isNull(), "all").when(F.col("have") == 4, "own").otherwise("some")
    return lacking.join(peers, "date", "left").groupBy("symbol", kind.alias("kind")).agg(F.count("*").alias("n"))


def relative_wealth(spark, sf_dir):
    """A rule against holding over the whole path and its halves, which share a bar."""
    bars = scored(spark, sf_dir)
    done = O.numbered(P.wealth(P.hysteresis(bars, S, 25, 75), S, 0.0025).drop("i", "n"), S)
    half = F.floor((F.col("n") - 1) / 2)
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    one = done.withColumn("h", half).groupBy("symbol").agg(*(at(c, i).alias(f"{c}{k}") for c in ("wealth", "close") for k, i in (("0", F.lit(0)), ("1", F.col("h")), ("2", F.col("n") - 1))))
    ratio = lambda a, b: (F.col(f"wealth{b}") / F.col(f"wealth{a}")) / (F.col(f"close{b}") / F.col(f"close{a}"))
    return rounded(one.select("symbol", ratio(0, 2).alias("whole"), ratio(0, 1).alias("first_half"), ratio(1, 2).alias("second_half")), "whole", "first_half", "second_half")


QUERIES = {f.__name__: f for f in (event_study, non_overlapping, walk_forward, walk_forward_line, cash_wealth, volatility_schedule, fragility, month_pairs, constant_mix, matched_volatility, rebased_vintage, auction_windows, excluded_windows, upserted, expected_days, gates, annual_winners, common_dates, peer_gaps, relative_wealth)}

HYST = "case when shown >= 75 then 0 when shown <= 25 then 1 end"
RULE = f"{event_sql(HYST, 1)}, {wealth_sql('0.0025')}"
ORACLES = {
    "event_study": f"""with {OBS_SQL}, s as (select *, floor(floor(score * 10 + 0.5) / 10 + 0.5) as shown from obs), l as (select symbol, shown, 5 as horizon, fwd_5 as y from s union all select symbol, shown, 21, fwd_21 from s union all select symbol, shown, 63, fwd_63 from s),
k as (select * from l where y is not null), a as (select symbol, horizon, avg(y) as m from k group by 1, 2), b(bucket, lo, hi) as (values ('<=15', 0, 15), ('<=25', 0, 25), ('40-60', 40, 60), ('>=75', 75, 100), ('>=85', 85, 100))
select k.symbol, k.horizon, bucket, count(*) as n, round(avg(y), 6) as mean, round(avg((y > 0)::int), 6) as share_up, round(avg(y) - any_value(m), 6) as gap from k join b on shown between lo and hi join a on a.symbol = k.symbol and a.horizon = k.horizon group by 1, 2, 3""",
    "non_overlapping": f"""with recursive {REGION_SQL}, r as (select * from (select symbol, row_number() over w as i, lead(date, 1) over w as entry, lead(date, 22) over w as exit from region_bars window w as (partition by symbol order by date)) where exit is not null),
c as (select symbol, min(entry) as entry, 1::bigint as k from r group by 1 union all select c.symbol, (select min(x.entry) from r x join r y on x.symbol = y.symbol and y.entry = c.entry and y.symbol = c.symbol and x.entry >= y.exit), k + 1 from c where c.entry is not null)
select symbol, (select count(*) from r where r.symbol = c.symbol) as rows, max(k) filter (entry is not null) as apart from c group by 1""",
    "walk_forward_line": f"""with {REGION_SQL}, x as (select symbol, date, ln(close / lag(close) over w) as x, ln(lead(close, 2) over w / lead(close, 1) over w) as y from region_bars window w as (partition by symbol order by date)),
n as (select *, row_number() over (partition by symbol order by date) - 1 as i from x where x is not null), b as (select *, (i - 504) // 21 as block from n where i >= 504),
f as (select k.symbol, k.block, regr_slope(n.y, n.x) as s, regr_intercept(n.y, n.x) as c from (select distinct symbol, block from b) k join n on n.symbol = k.symbol and n.i + 2 <= 504 + 21 * k.block where n.y is not null group by 1, 2)
select b.symbol, b.date, round(b.y, 6) as label, b.block, round(c + s * b.x, 6) as forecast from b join f on f.symbol = b.symbol and f.block = b.block""",
    "cash_wealth": f"""with {REGION_SQL}, y as (select o_orderdate::date as date, (sum(round(o_totalprice * 100)::bigint) % 500)::double / 100 as p from orders group by 1),
s as (select symbol, min(date) as f, max(date) as l from region_bars group by 1), d as (select symbol, unnest(generate_series(f + 1, l, interval 1 day))::date as day from s),
k as (select d.symbol, d.day, case when (d.day - 1) - y.date <= 7 then p end as p from (select *, day - 1 as before from d) d asof left join y on d.before >= y.date),
g as (select symbol, day, sum(coalesce(ln(pow(1 / (1 - p / 100 * 91 / 360), 1 / 91.0::double)), 0)) over w as g, sum((p is null)::int) over w as dry from k window w as (partition by symbol order by day))
select r.symbol, r.date, round(coalesce(exp(g), 1), 6) as wealth, coalesce(dry, 0) as days_without from region_bars r left join g on r.symbol = g.symbol and r.date = g.day""",
    "fragility": f"""with {SCORE_SQL}, p as (select date, max(case when symbol = 'AFRICA' then score end) as a, max(case when symbol = 'AMERICA' then score end) as b, max(case when symbol = 'ASIA' then score end) as c, max(case when symbol = 'EUROPE' then score end) as d, max(case when symbol = 'MIDDLE EAST' then score end) as e from scored group by 1),
q as (select *, lag(a, 5) over w as a5, lag(b, 5) over w as b5, lag(c, 5) over w as c5, lag(d, 5) over w as d5, lag(e, 5) over w as e5, (a + b + c + d + e) / 5 as m from p where a + b + c + d + e is not null window w as (order by date))
select 'world' as k, date, round(sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2) + pow(d - m, 2) + pow(e - m, 2)) / 5) / 100 * sqrt((pow(greatest(0, a5 - a), 2) + pow(greatest(0, b5 - b), 2) + pow(greatest(0, c5 - c), 2) + pow(greatest(0, d5 - d), 2) + pow(greatest(0, e5 - e), 2)) / 5) / 100, 6) as fragility from q where a5 is not null""",
    "month_pairs": f"""with {DAMPED}, {RULE}, j as (select symbol, date, wealth as x, close / first_value(close) over (partition by symbol order by date) as y from w), e as (select symbol, date_trunc('month', date)::date as month, max_by(x, date) as x, max_by(y, date) as y from j group by 1, 2),
g as (select symbol, month, ln(x / lag(x) over v) as gx, ln(y / lag(y) over v) as gy from e window v as (partition by symbol order by month)) select symbol, month, round(gx, 6) as gx, round(gy, 6) as gy, case when abs(round(gx - gy, 6)) < 1e-6 then 0 else round(gx - gy, 6) end as difference from g where gx is not null""",
    "constant_mix": f"with {DAMPED}, r as (select symbol, close / lag(close) over (partition by symbol order by date) - 1 as r from b) select symbol, round(exp(sum(ln(1 + 0.5 * r))), 6) as mixed, round(exp(sum(ln(1 + r))), 6) as held, round(stddev_samp(0.5 * r), 6) as sd from r group by 1",
    "matched_volatility": f"""with {DAMPED}, {event_sql(HYST, 1)}, {wealth_sql('0')}, v as (select symbol, stddev_samp(growth) as rule, stddev_samp(move) as full_ from w group by 1), g as (select symbol, i / 1000.0::double as weight, round(abs(i / 1000.0::double * full_ - rule), 12) as gap from v, range(1001) t(i))
select symbol, weight from g qualify row_number() over (partition by symbol order by gap, weight) = 1""",
    "rebased_vintage": f"""with {SLOT_SQL} select symbol, date, round(close, 6) as close from slot_bars where date >= date '2000-01-01' and symbol in (select symbol from slot_bars where date < date '2000-01-01')""",
    "auction_windows": """with d as (select distinct o_orderdate::date as date from orders), v as (select date, 1 + (date - date '1990-01-01') / 100000.0::double as v from d),
e as (select o_orderpriority, (b.v / a.v - 1 - (1 + o_orderkey % 100 / 10000.0::double - 1)) * 10000 as e from orders join v a on a.date = o_orderdate::date join v b on b.date = o_orderdate::date + 91)
select o_orderpriority, count(*) as n, round(avg(e), 6) as mean, round(avg(abs(e)), 6) as mae, round(sqrt(avg(e * e)), 6) as rmse, round(quantile_cont(abs(e), 0.5), 6) as p50, round(quantile_cont(abs(e), 0.9), 6) as p90, round(quantile_cont(abs(e), 0.99), 6) as p99, round(max(abs(e)), 6) as worst from e group by 1""",
    "excluded_windows": f"with {SLOT_SQL}, a as (select date from slot_bars where symbol = 'A') select case when o_orderdate::date not in (select date from a) then 'no value at start' when o_orderdate::date + 91 not in (select date from a) then 'no value at end' else 'told' end as reason, count(*) as n from orders group by 1",
    "upserted": """with f as (select o_custkey, min_by(o_orderstatus, o_orderkey) as d0, min_by(o_orderdate, o_orderkey) as m0, max_by(o_orderstatus, o_orderkey) as d1, max_by(o_orderdate, o_orderkey) as m1 from orders group by 1)
select o_custkey, case when o_custkey % 3 = 0 or (d1 <> d0 and m1 >= m0) then d1 else d0 end as digest, (case when o_custkey % 3 = 0 or (d1 <> d0 and m1 >= m0) then m1 else m0 end)::date as modified, case when o_custkey % 3 <> 0 and d1 <> d0 and m1 >= m0 then 1 else 0 end as revision from f""",
    "expected_days": f"with {REGION_SQL}, l as (select symbol, max(date) as last from region_bars group by 1) select symbol, d::date as date from l, generate_series(last + 1, date '2001-12-31', interval 1 day) t(d) where dayofweek(d) not in (0, 6)",
    "gates": f"""with {DAMPED}, {RULE}, m as (select symbol, max_by(wealth, date) > max_by(close, date) / min_by(close, date) as beats_holding, max(turnover) >= 10 as trades, avg(position) > 0.5 as mostly_in, min(wealth) > 0.5 as never_halved from w group by 1)
select *, beats_holding::int + trades::int + mostly_in::int + never_halved::int as passed, concat_ws(',', case when not beats_holding then 'beats_holding' end, case when not trades then 'trades' end, case when not mostly_in then 'mostly_in' end, case when not never_halved then 'never_halved' end) as failed, beats_holding and trades and mostly_in and never_halved as all_pass from m""",
    "annual_winners": f"""with {DAMPED}, g as (select b.*, fear, greed from b, (values (15), (20), (25)) f(fear), (values (70), (75), (80)) h(greed)), {event_sql('case when shown >= greed then 0 when shown <= fear then 1 end', 1, source='g', key='symbol, fear, greed')}, {wealth_sql('0.0025', key='symbol, fear, greed')},
y as (select symbol, fear, greed, year(date) as year, round(sum(ln(growth)), 6) as g from w group by 1, 2, 3, 4), t as (select y.year + k as year, fear, greed, avg(g) as mean, count(distinct y.year) as years from y, range(1, 4) r(k) group by 1, 2, 3)
select year, fear, greed, round(mean, 6) as mean from t where years = 3 qualify row_number() over (partition by year order by mean desc, fear, greed) = 1""",
    "common_dates": f"with {REGION_SQL}, d as (select date from region_bars group by 1 having count(*) = (select count(distinct symbol) from region_bars)) select count(*) as days, min(date) as first, max(date) as last, round((max(date) - min(date)) / 365.2425::double, 6) as years from d",
    "peer_gaps": f"""with {REGION_SQL}, {SLOT_SQL}, l as (select s.symbol, d.date from (select distinct symbol from region_bars) s, (select distinct date from slot_bars) d where not exists (select 1 from region_bars r where r.symbol = s.symbol and r.date = d.date)),
p as (select date, count(*) as have from region_bars group by 1) select symbol, case when have is null then 'all' when have = 4 then 'own' else 'some' end as kind, count(*) as n from l left join p using (date) group by 1, 2""",
    "relative_wealth": f"""with {DAMPED}, {RULE}, h as (select *, (n - 1) // 2 as h from w), o as (select symbol, max(wealth) filter (i = 0) as w0, max(wealth) filter (i = h) as w1, max(wealth) filter (i = n - 1) as w2, max(close) filter (i = 0) as c0, max(close) filter (i = h) as c1, max(close) filter (i = n - 1) as c2 from h group by 1)
select symbol, round((w2 / w0) / (c2 / c0), 6) as whole, round((w1 / w0) / (c1 / c0), 6) as first_half, round((w2 / w1) / (c2 / c1), 6) as second_half from o""",
}
