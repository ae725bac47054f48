"""Leveraged policies, switching rules, participation, shareholder tables and auctions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outcomes as O, policies as K, positions as P, studies as D, windows as W
from ..sources.bars import REGION_SQL, SLOT_SQL, cents, region_bars, slot_bars, table
from .outcomes import momentum_scores
from .sentiment import rounded
from .studies import annual_winners
from .trading import DAMPED, event_sql, scored

S = ["symbol"]


def sentiment_overlay(spark, sf_dir):
    return rounded(K.sentiment_overlay(scored(spark, sf_dir), S), "wealth", "exposure", "traded", "financing")


def volatility_managed(spark, sf_dir):
    """Monthly targets from the variance ratio, traded with borrowed money above one and a margin floor."""
    bars = scored(spark, sf_dir).select("symbol", "date", "close")
    states = O.monthly_variance(bars.withColumn("r", W.log_return(F.col("close"), S)), S)
    schedule = D.banded_schedule(states.select("symbol", "month", "ratio"), S, 0.5, 1.5)
    return rounded(K.leveraged(K.scheduled(bars, schedule, S), S, 0.002, 0.015, 0.0, 0.4), "wealth", "exposure", "traded", "financing")


def switched_rule(spark, sf_dir):
    """Thresholds chosen anew each year."""
    winners = annual_winners(spark, sf_dir)
    return rounded(P.wealth(K.switched(scored(spark, sf_dir), winners, S), S, 0.0025).select("symbol", "date", "position", "wealth"), "wealth")


def cash_episodes(spark, sf_dir):
    return K.cash_episodes(P.hysteresis(scored(spark, sf_dir), S, 25, 75), S)


def cross_market(spark, sf_dir):
    """Mean next return after a high and after a low score of each other region."""
    scores = momentum_scores(spark, sf_dir).withColumnRenamed("symbol", "market")
    pairs = K.cross_market(scores.select("market", "date", "score"), scores.select("market", "date", "close"))
    keys = ["traded", "signal"]
    moved = pairs.withColumn("f", F.lead("close", 2).over(W.series(keys)) / F.lead("close", 1).over(W.series(keys)) - 1)
    return moved.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("score") >= 75, F.col("f"))), 6).alias("after_high"), F.round(F.avg(F.when(F.col("score") <= 25, F.col("f"))), 6).alias("after_low"))


def participation(spark, sf_dir):
    bars = slot_bars(spark, sf_dir).withColumn("market", F.when(F.length("symbol") == 1, "flags").otherwise("lines"))
    return rounded(K.participation(bars, ["market"], "symbol"), "score", "above")


def shareholder_tables(spark, sf_dir):
    """Customers by segment as holders in tables embedded in pages of a bounded number of rows, read again."""
    c = table(spark, sf_dir, "customer").withColumn("cents", cents(F.abs("c_acctbal")))
    turkish = lambda x: F.translate(F.format_number(x, 2), ",.", ".,")
    row = F.struct(F.col("c_name").alias("shareholder"), turkish(F.col("cents") / 100).alias("shareInCapital"), turkish(F.col("c_custkey") % 100 + F.lit(0.25)).alias("ratioInCapital"), F.lit("1,00").alias("votingRightRatio"))
    listed = c.groupBy("c_mktsegment", F.floor(F.col("c_custkey") / 1000).alias("page")).agg(F.to_json(F.collect_list(row)).alias("j"))
    html = F.concat(F.lit('<script>x("'), F.replace(F.concat(F.lit('{"itemKey":"holders","value":'), "j", F.lit(',"disclosureIndex":null,"creationDate":"05/09/2026 10:00:00"}')), F.lit('"'), F.lit('\\"')), F.lit('")</script>'))
    items = K.item_values(listed.select("c_mktsegment", html.alias("html")), "html", "holders")
    return K.shareholders(items, ["c_mktsegment"]).select("c_mktsegment", "dated", "holder", "shares", "pct", "other", "total")


def holder_changes(spark, sf_dir):
    """Quarterly tables of suppliers' order lines by nation."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.trunc("l_shipdate", "year").alias("seen"), cents(F.col("l_extendedprice")).alias("c"), "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    sums = lines.groupBy("l_suppkey", "seen").agg(F.sum("l_quantity").alias("shares"), F.pmod(F.sum("c"), F.lit(40)).cast("double").alias("pct"))
    rows = sums.join(supplier, "l_suppkey").filter("pct >= 10").withColumnRenamed("l_suppkey", "holder")
    return K.holder_changes(rows, ["nation"], "seen").select("nation", "seen", "holder", "kind", "shares_from", "shares_to", "pct_from", "pct_to")


def auctions(spark, sf_dir):
    """Orders as auctions of bills."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("cusip"), F.lit("13-Week").alias("security_term"), day.alias("auction_date"), F.date_add(day, 3).alias("issue_date"), F.date_add(day, 94).alias("maturity_date"), (99 - F.col("o_orderkey") % 10 / 10).alias("high_price"), (98 - F.col("o_orderkey") % 7 / 10).alias("avg_med_price"))
    return rounded(K.auctions(o), "price", "growth")


def new_intervals(spark, sf_dir):
    """Latest ten days with orders of a customer after those of even customers up to 2000 have been told."""
    e = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("to")).distinct()
    return K.new_intervals(e, e.filter("o_custkey % 2 = 0 and to < '2001-01-01'"), ["o_custkey"], 10)


def shift_offsets(spark, sf_dir):
    n = region_bars(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    return n.select("symbol", F.explode(K.shift_offsets(F.col("n"), 99)).alias("offset"))


QUERIES = {f.__name__: f for f in (sentiment_overlay, volatility_managed, switched_rule, cash_episodes, cross_market, participation, shareholder_tables, holder_changes, auctions, new_intervals, shift_offsets)}

ORACLES = {
    "cash_episodes": f"""with {DAMPED}, {event_sql('case when shown >= 75 then 0 when shown <= 25 then 1 end', 1)}, t as (select * from (select symbol, date, i, position, lag(position) over (partition by symbol order by date) as before from p) where before <> position),
n as (select *, lead(date) over (partition by symbol order by date) as back, lead(i) over (partition by symbol order by date) - i as bars from t) select symbol, date as out, back, bars from n where position = 0 and back is not null""",
    "cross_market": f"""with {DAMPED}, c as (select a.symbol as traded, g.symbol as signal, a.date, r.close from b a join region_bars r on a.symbol = r.symbol and a.date = r.date, (select distinct symbol from b) g where g.symbol <> a.symbol), s as (select symbol, date, score from b where score is not null),
f as (select c.*, s.score, s.date as as_of from c asof join s on c.signal = s.symbol and c.date >= s.date), k as (select traded, signal, score, lead(close, 2) over w / lead(close, 1) over w - 1 as f from f where date - as_of <= 7 window w as (partition by traded, signal order by date))
select traded, signal, count(*) as n, round(avg(f) filter (score >= 75), 6) as after_high, round(avg(f) filter (score <= 25), 6) as after_low from k group by 1, 2""",
    "participation": f"""with {SLOT_SQL}, r as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from slot_bars), g as (select case when length(symbol) = 1 then 'flags' else 'lines' end as market, date,
case when count(*) over (partition by symbol order by date rows 99 preceding) = 100 then ln(close / avg(close) over (partition by symbol order by date rows 99 preceding)) end as g, stddev_samp(r) over (partition by symbol order by date rows 62 preceding) as sd from r)
select market, date, round(avg(least(100, greatest(0, 50 + 25 * g / (sd * sqrt(20))))), 6) as score, round(avg((g > 0)::int), 6) as above, count(*) as n from g where g is not null group by 1, 2 having count(*) >= 2""",
    "shareholder_tables": "select c_mktsegment, date '2026-09-05' as dated, c_name as holder, round(abs(c_acctbal) * 100)::bigint::double / 100 as shares, (c_custkey % 100 + 0.25)::double as pct, false as other, false as total from customer",
    "holder_changes": """with r as (select s_nationkey as nation, l_suppkey as holder, date_trunc('year', l_shipdate)::date as seen, sum(l_quantity) as shares, (sum(round(l_extendedprice * 100)::bigint) % 40)::double as pct from lineitem join supplier on s_suppkey = l_suppkey group by 1, 2, 3 having sum(round(l_extendedprice * 100)::bigint) % 40 >= 10),
t as (select nation, seen, lead(seen) over (partition by nation order by seen) as nxt from (select distinct nation, seen from r)), a as (select r.nation, t.nxt as seen, holder, shares, pct from r join t on r.nation = t.nation and r.seen = t.seen where nxt is not null),
b as (select r.* from r join t on r.nation = t.nation and r.seen = t.nxt)
select coalesce(a.nation, b.nation) as nation, coalesce(a.seen, b.seen) as seen, coalesce(a.holder, b.holder) as holder, case when a.holder is null then 'listed' when b.holder is null then 'no longer listed' when b.pct > a.pct then 'up' when b.pct < a.pct then 'down' else 'capital change' end as kind,
a.shares as shares_from, b.shares as shares_to, a.pct as pct_from, b.pct as pct_to from a full join b on a.nation = b.nation and a.seen = b.seen and a.holder = b.holder where a.holder is null or b.holder is null or abs(a.shares - b.shares) >= 1 or a.pct <> b.pct""",
    "auctions": "select o_orderkey::varchar as cusip, o_orderdate::date as auction_date, o_orderdate::date + 3 as issue_date, o_orderdate::date + 94 as maturity_date, 91 as days, round(p, 6) as price, round(100 / p - 1, 6) as growth from (select *, case when o_orderdate::date >= date '1998-11-02' then 99 - o_orderkey % 10 / 10.0::double else 98 - o_orderkey % 7 / 10.0::double end as p from orders)",
    "new_intervals": """with e as (select distinct o_custkey, o_orderdate::date as "to" from orders), m as (select * from e where o_custkey % 2 = 0 and "to" < date '2001-01-01') select * from e where "to" > (select max("to") from m) order by "to" desc, o_custkey limit 10""",
    "shift_offsets": f"with {REGION_SQL}, n as (select symbol, count(*) as n from region_bars group by 1) select distinct symbol, floor(k * n / 100.0::double)::bigint as \"offset\" from n, range(1, 100) t(k) where floor(k * n / 100.0::double) > 0",
}
