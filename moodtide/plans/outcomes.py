"""Features, forward outcomes, splits and calendar steps over the region bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import outcomes as O, windows as W
from ..sources.bars import REGION_SQL, region_bars
from .sentiment import momentum_sql, rounded

S = ["symbol"]


def momentum_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, close, score: the percentile of momentum among all so far."""
    bars = region_bars(spark, sf_dir)
    scores = W.expanding_midrank(W.momentum(bars, S), S).select("symbol", "date", "score")
    return bars.join(scores, ["symbol", "date"])


SCORE_SQL = f"""{REGION_SQL}, mom as (select * from ({momentum_sql('region_bars')}) where raw is not null),
ranked as (select a.symbol, a.date, count(*) as k, 100.0 * sum(case when b.raw < a.raw then 1.0 when b.raw = a.raw then 0.5 else 0 end) / count(*) as p from mom a join mom b on a.symbol = b.symbol and b.date <= a.date group by 1, 2),
scored as (select r.symbol, r.date, r.close, case when k >= 126 then p end as score from region_bars r left join ranked using (symbol, date)),
steps as (select *, row_number() over w - 1 as i, count(*) over (partition by symbol) as n, lead(close, 1) over w as c1, ln(close / lag(close) over w) as r from scored window w as (partition by symbol order by date))"""


def forward_returns(spark, sf_dir):
    f = O.forward_returns(region_bars(spark, sf_dir), S)
    return rounded(f.filter("fwd_63 is not null"), "fwd_1", "fwd_5", "fwd_21", "fwd_63", "label")


def future_log_vol(spark, sf_dir):
    return rounded(O.future_log_vol(region_bars(spark, sf_dir), S).filter("log_vol is not null"), "log_vol")


def forward_drawdown(spark, sf_dir):
    return rounded(O.forward_drawdown(region_bars(spark, sf_dir), S).filter("outcome is not null"), "drawdown", "outcome")


def controls(spark, sf_dir):
    return rounded(O.controls(region_bars(spark, sf_dir), S), "r1", "r5", "r20", "vol20", "trend125")


def learner_features(spark, sf_dir):
    f = O.learner_features(momentum_scores(spark, sf_dir), S)
    return rounded(f, "score", "log1", "log5", "log20", "vol20", "trend", "centre", "square", "d1", "d5", "d21", "interaction")


def state_vector(spark, sf_dir):
    f = O.state_vector(region_bars(spark, sf_dir), S).filter("sma200 is not null")
    return rounded(f, "sma100", "sma200", "vol20", "vol63", "drawdown", "trend_score", "strength_score", "volatility_score")


def month_ends(spark, sf_dir):
    return rounded(O.month_ends(region_bars(spark, sf_dir), S), "close")


def month_mean_orders(spark, sf_dir):
    return rounded(O.month_mean_orders(region_bars(spark, sf_dir), S), "mean")


def trailing_year_reference(spark, sf_dir):
    return rounded(O.trailing_year_reference(region_bars(spark, sf_dir), S).filter("reference is not null"), "close", "reference")


def split_50_25_25(spark, sf_dir):
    p = O.split(region_bars(spark, sf_dir), S, (0.5, 0.75), ("train", "validate", "test"))
    return p.groupBy("symbol", "part").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"))


def purged_split(spark, sf_dir):
    bars = region_bars(spark, sf_dir)
    w = W.series(S)
    obs = bars.select("symbol", "date", F.lead("date", 1).over(w).alias("entry"), F.lead("date", 22).over(w).alias("exit")).filter("exit is not null")
    return O.purged_split(obs, S).groupBy("symbol", "part").agg(F.count("*").alias("n"), F.max("exit").alias("last_exit"), F.min("entry").alias("first_entry"))


def rotated_scores(spark, sf_dir):
    bars = region_bars(spark, sf_dir).select("symbol", "date", "close")
    return rounded(O.rotated(bars, S, "close", F.lit(100)), "close", "close_rotated")


def monthly_variance(spark, sf_dir):
    bars = region_bars(spark, sf_dir)
    return rounded(O.monthly_variance(bars.withColumn("r", W.log_return(F.col("close"), S)), S), "variance", "ratio")


def momentum_rank(spark, sf_dir):
    """Regions by their return over 252 bars, best first, on each date that all have; the best one against none if it fell."""
    bars = region_bars(spark, sf_dir).withColumn("ret", F.col("close") / F.lag("close", 252).over(W.series(S)) - 1).filter("ret is not null")
    per = W.Window.partitionBy("date")
    ranked = bars.withColumn("rank", F.row_number().over(per.orderBy(F.desc("ret"), "symbol"))).withColumn("n", F.count("*").over(per)).filter("n = 5 and rank <= 2")
    return ranked.select("date", "symbol", "rank", F.round("ret", 6).alias("ret"), F.when((F.col("rank") == 1) & (F.col("ret") > 0), 1).otherwise(0).alias("held"))


def complete_years(spark, sf_dir):
    """Years of a region that have a bar before and after them, and the year's growth from the last close before it."""
    bars = region_bars(spark, sf_dir).withColumn("year", F.year("date"))
    ends = bars.groupBy("symbol", "year").agg(F.max_by("close", "date").alias("last"), F.count("*").alias("n"))
    w = W.Window.partitionBy("symbol").orderBy("year")
    near = ends.withColumn("before", F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("last").over(w))).withColumn("after", F.lead("year").over(w) == F.col("year") + 1)
    return near.filter("before is not null and after").select("symbol", "year", "n", F.round(F.col("last") / F.col("before") - 1, 6).alias("growth"))


def interval_growth(spark, sf_dir):
    """Growth of close and of cash (a yield made from the orders' mean price, known the day before) over each interval of bars."""
    from ..functions.numbers import discount_growth

    bars = region_bars(spark, sf_dir)
    yields = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.pmod(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), F.lit(500)) / 100).alias("yield"))
    w = W.series(S)
    steps = bars.withColumn("previous", F.lag("date").over(w)).withColumn("growth", F.col("close") / F.lag("close").over(w)).filter("previous is not null")
    known = W.as_of(steps.select("symbol", F.date_sub("date", 1).alias("date")), yields.join(bars.select("symbol").distinct()), S, ["yield"], 7)
    known = known.select("symbol", F.date_add("date", 1).alias("date"), "yield", "as_of")
    joined = steps.join(known, ["symbol", "date"], "left")
    days = F.datediff("date", "previous")
    return joined.select("symbol", "date", F.round("growth", 6).alias("growth"), F.round(discount_growth(F.col("yield"), days), 8).alias("cash"), F.when(F.col("yield").isNull(), "no fresh yield").alias("reason"))


QUERIES = {f.__name__: f for f in (forward_returns, future_log_vol, forward_drawdown, controls, learner_features, state_vector, month_ends, month_mean_orders, trailing_year_reference, split_50_25_25, purged_split, rotated_scores, monthly_variance, momentum_rank, complete_years, interval_growth)}

_N = lambda x: f"case when {x} is not null then least(100, greatest(0, {x})) end"
ORACLES = {
    "forward_returns": f"with {REGION_SQL} select * from (select symbol, date, " + ", ".join(f"round(lead(close, {1 + h}) over w / lead(close, 1) over w - 1, 6) as fwd_{h}" for h in (1, 5, 21, 63)) + ", round(ln(lead(close, 2) over w / lead(close, 1) over w), 6) as label from region_bars window w as (partition by symbol order by date)) where fwd_63 is not null",
    "future_log_vol": f"with {REGION_SQL}, r as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars) select * from (select symbol, date, case when count(r) over w = 21 then round(ln(stddev_samp(r) over w), 6) end as log_vol from r window w as (partition by symbol order by date rows between 2 following and 22 following)) where log_vol is not null",
    "forward_drawdown": f"""with {REGION_SQL}, b as (select *, row_number() over w as i, ln(close / lag(close) over w) as r from region_bars window w as (partition by symbol order by date)),
v as (select *, case when count(r) over w = 20 then stddev_samp(r) over w end as sd from b window w as (partition by symbol order by date rows 19 preceding)),
f as (select a.symbol, a.i, max(ln(x.close / y.close)) as fall from b a join b x on a.symbol = x.symbol and x.i between a.i + 1 and a.i + 22 join b y on a.symbol = y.symbol and y.i between x.i and a.i + 22 group by 1, 2)
select v.symbol, v.date, round(fall, 6) as drawdown, round(ln(1 + fall / (sd * sqrt(21))), 6) as outcome from v join f on v.symbol = f.symbol and v.i = f.i where sd is not null and v.i + 22 <= (select count(*) from b z where z.symbol = v.symbol)""",
    "controls": f"""with {REGION_SQL}, b as (select *, close / lag(close) over w - 1 as r, row_number() over w as i from region_bars window w as (partition by symbol order by date))
select symbol, date, round(r1, 6) as r1, round(r5, 6) as r5, round(r20, 6) as r20, round(vol20, 6) as vol20, round(trend125, 6) as trend125 from (select symbol, date, i, r as r1, close / lag(close, 5) over w - 1 as r5, close / lag(close, 20) over w - 1 as r20,
stddev_samp(r) over (partition by symbol order by date rows 19 preceding) * sqrt(252) as vol20, close / avg(close) over (partition by symbol order by date rows 124 preceding) - 1 as trend125 from b window w as (partition by symbol order by date)) where i > 125""",
    "learner_features": f"""with {SCORE_SQL}, f as (select symbol, date, score, ln(close / lag(close) over w) as log1, ln(close / lag(close, 5) over w) as log5, ln(close / lag(close, 20) over w) as log20,
case when count(r) over v = 20 then stddev_pop(r) over v end as vol20, case when i >= 124 then ln(close / avg(close) over (partition by symbol order by date rows 124 preceding)) end as trend, score - 50 as centre, pow(score - 50, 2) as square,
score - lag(score) over w as d1, score - lag(score, 5) over w as d5, score - lag(score, 21) over w as d21 from steps window w as (partition by symbol order by date), v as (partition by symbol order by date rows 19 preceding))
select symbol, date, round(score, 6) as score, round(log1, 6) as log1, round(log5, 6) as log5, round(log20, 6) as log20, round(vol20, 6) as vol20, round(trend, 6) as trend, round(centre, 6) as centre, round(square, 6) as square, round(d1, 6) as d1, round(d5, 6) as d5, round(d21, 6) as d21, round(centre * trend, 6) as interaction,
concat_ws(',', case when score is null then 'no score' end, case when log20 is null then 'short history' end, case when trend is null then 'no trend' end, case when d21 is null then 'no score change' end) as reasons from f""",
    "state_vector": f"""with {REGION_SQL}, b as (select *, ln(close / lag(close) over w) as r, row_number() over w as i from region_bars window w as (partition by symbol order by date)),
s as (select symbol, date, ln(close / avg(close) over (partition by symbol order by date rows 99 preceding)) as sma100, case when i >= 200 then ln(close / avg(close) over (partition by symbol order by date rows 199 preceding)) end as sma200,
stddev_samp(r) over (partition by symbol order by date rows 19 preceding) as vol20, stddev_samp(r) over (partition by symbol order by date rows 62 preceding) as vol63, case when i >= 253 then stddev_samp(r) over (partition by symbol order by date rows 251 preceding) end as vol252,
case when i >= 252 then ln(close / max(close) over (partition by symbol order by date rows 251 preceding)) end as drawdown from b)
select symbol, date, round(sma100, 6) as sma100, round(sma200, 6) as sma200, round(vol20, 6) as vol20, round(vol63, 6) as vol63, round(drawdown, 6) as drawdown, round({_N('50 + 25 * sma200 / (vol63 * sqrt(20))')}, 6) as trend_score,
round({_N('100 + 50 * drawdown / (vol63 * sqrt(20))')}, 6) as strength_score, round({_N('50 - 50 * log2(vol20 / vol252)')}, 6) as volatility_score from s where sma200 is not null""",
    "month_ends": f"with {REGION_SQL} select symbol, max(date) as date, round(max_by(close, date), 6) as close from region_bars group by symbol, date_trunc('month', date)",
    "month_mean_orders": f"""with {REGION_SQL}, b as (select *, lead(date) over (partition by symbol order by date) as execution from region_bars),
e as (select * from b qualify row_number() over (partition by symbol, date_trunc('month', date) order by date desc) = 1),
m as (select *, case when count(*) over w = 10 then avg(close) over w end as mean from e window w as (partition by symbol order by date rows 9 preceding))
select symbol, date, execution, round(mean, 6) as mean, (close > mean)::int as target from m where mean is not null and execution is not null""",
    "trailing_year_reference": f"""with {REGION_SQL}, a as (select symbol, date, close, date - 365 as d from region_bars)
select a.symbol, a.date, round(a.close, 6) as close, round(b.close, 6) as reference, b.date as reference_date from a asof join region_bars b on a.symbol = b.symbol and a.d >= b.date where a.d - b.date <= 7""",
    "split_50_25_25": f"""with {REGION_SQL}, b as (select *, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n from region_bars)
select symbol, case when i < floor(n * 0.5) then 'train' when i < floor(n * 0.75) then 'validate' else 'test' end as part, count(*) as n, min(date) as first, max(date) as last from b group by 1, 2""",
    "purged_split": f"""with {REGION_SQL}, o as (select * from (select symbol, date, lead(date, 1) over w as entry, lead(date, 22) over w as exit from region_bars window w as (partition by symbol order by date)) where exit is not null),
p as (select *, case when row_number() over (partition by symbol order by date) - 1 < floor(count(*) over (partition by symbol) * 0.6) then 'train' else 'test' end as part from o),
q as (select *, min(entry) filter (part = 'test') over (partition by symbol) as f from p)
select symbol, part, count(*) as n, max(exit) as last_exit, min(entry) as first_entry from q where part = 'test' or exit <= f group by 1, 2""",
    "rotated_scores": f"""with {REGION_SQL}, b as (select *, row_number() over (partition by symbol order by date) - 1 as i, count(*) over (partition by symbol) as n from region_bars)
select b.symbol, b.date, round(b.close, 6) as close, round(a.close, 6) as close_rotated from b join b a on a.symbol = b.symbol and b.i = (a.i + 100) % a.n""",
    "monthly_variance": f"""with {REGION_SQL}, r as (select symbol, date, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars),
m as (select symbol, date_trunc('month', date)::date as month, avg(r * r) as variance, count(*) as n from r where r is not null group by 1, 2 having count(*) >= 15)
select a.symbol, a.month, round(any_value(a.variance), 6) as variance, any_value(a.n) as n, round(case when count(b.variance) = 12 then median(b.variance) end / any_value(a.variance), 6) as ratio from m a left join m b on a.symbol = b.symbol and b.month < a.month and b.month >= a.month - interval 12 month group by 1, 2""",
    "momentum_rank": f"""with {REGION_SQL}, b as (select symbol, date, close / lag(close, 252) over (partition by symbol order by date) - 1 as ret from region_bars),
k as (select *, row_number() over (partition by date order by ret desc, symbol)::int as rank, count(*) over (partition by date) as n from b where ret is not null)
select date, symbol, rank, round(ret, 6) as ret, case when rank = 1 and ret > 0 then 1 else 0 end as held from k where n = 5 and rank <= 2""",
    "complete_years": f"""with {REGION_SQL}, e as (select symbol, year(date)::int as year, max_by(close, date) as last, count(*) as n from region_bars group by 1, 2)
select a.symbol, a.year, a.n, round(a.last / b.last - 1, 6) as growth from e a join e b on a.symbol = b.symbol and b.year = a.year - 1 join e c on a.symbol = c.symbol and c.year = a.year + 1""",
    "interval_growth": f"""with {REGION_SQL}, y as (select o_orderdate::date as date, (sum(round(o_totalprice * 100)::bigint) % 500)::double / 100 as yield from orders group by 1),
s as (select * from (select symbol, date, close / lag(close) over w as growth, date - lag(date) over w as days, date - 1 as d from region_bars window w as (partition by symbol order by date)) where growth is not null),
k as (select s.*, y.yield, y.date as as_of from s asof left join y on s.d >= y.date)
select symbol, date, round(growth, 6) as growth, round(case when d - as_of <= 7 then pow(1 / (1 - yield / 100 * 91 / 360), days / 91.0::double) end, 8) as cash, case when as_of is null or d - as_of > 7 then 'no fresh yield' end as reason from k""",
}
