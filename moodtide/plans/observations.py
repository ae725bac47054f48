"""Filings in their order, totals against declarations, newest observations, freshness, quotes, signs and periods over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calendars as C, observations as B, windows as W
from ..sources.bars import REGION_SQL, SLOT_SQL, cents, region_bars, slot_bars, table
from .disclosure import CAL_SQL
from .sentiment import rounded
from .trading import S

#: Starts of the periods of sub_periods.
STARTS = ["1996-01-01", "1997-07-01", "2000-01-01"]


def report_order(spark, sf_dir):
    """Orders as filings of their customers: some amendments, some other forms, some without a date, a time or a document."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    form = F.element_at(F.array(*map(F.lit, ("NPORT-P", "NPORT-P/A", "13F-HR", "NPORT-P"))), (k % 4 + 1).cast("int"))
    filed = F.date_format(day, "yyyy-MM-dd")
    filings = table(spark, sf_dir, "orders").select(
        "o_custkey", k.alias("accession"), form.alias("form"), F.when(k % 9 != 0, F.date_format(F.last_day(F.add_months(day, -2)), "yyyy-MM-dd")).otherwise("2000").alias("report"), filed.alias("filed"),
        F.when(k % 5 != 0, F.concat(filed, F.lit("T12"))).alias("accepted"), F.when(k % 3 == 0, F.concat(F.lit("x/y/d"), k)).when(k % 3 == 1, "z/").alias("document"),
    )
    return B.report_order(filings, ["o_custkey"]).select("o_custkey", "accession", "amends", "document", "place")


def declared_totals(spark, sf_dir):
    """Lines of an order as a table of holdings, declared as the order's lines add up, but for some made wrong; some tables are lost."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", cents(F.col("l_extendedprice")).alias("c"))
    k = F.col("l_orderkey")
    declared = lines.groupBy("l_orderkey").agg(F.count("*").alias("declared_n"), F.sum("c").alias("declared_total"))
    declared = declared.select("l_orderkey", (F.col("declared_n") + (k % 97 == 0).cast("int")).alias("declared_n"), (F.col("declared_total") + (k % 89 == 0).cast("int")).alias("declared_total"))
    return B.total_mismatches(lines.filter(k % 101 != 0), declared, ["l_orderkey"], "c")


def newest_observation(spark, sf_dir):
    """A customer's orders by day as history, but for the latest of every other customer, which comes as the daily observation."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("date")).agg((F.sum(cents(F.col("o_totalprice"))) / 100).alias("nav"))
    last = o.groupBy("o_custkey").agg(F.max_by("nav", "date").alias("nav"), F.max("date").alias("date")).filter("o_custkey % 2 = 0")
    daily = last.select("o_custkey", F.expr("date_sub(date, cast(o_custkey % 3 as int))").alias("date"), "nav", F.lit(0.5).alias("change"))
    history = o.join(daily.filter("o_custkey % 6 = 0").select("o_custkey", "date"), ["o_custkey", "date"], "left_anti")
    return rounded(B.newest_observation(daily, history, ["o_custkey"]), "change")


def file_freshness(spark, sf_dir):
    """Orders' dates as those of files, looked at from four days before to six days after."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")).filter("date is not null")
    o = o.withColumn("checked", F.expr("date_add(date, cast(o_orderkey % 11 as int) - 4)"))
    first, last = o.agg(F.min("checked"), F.max("checked")).first()
    days = C.calendar(spark, str(first or "2000-01-01"), str(last or "2000-01-02")).select(F.col("date").alias("checked"), "next_session")
    out = o.join(days, "checked", "left")
    return out.select("o_orderkey", "checked", F.datediff("checked", "date").alias("age"), B.freshness(F.col("date"), F.col("checked"), F.col("next_session")).alias("state"))


def quotes(spark, sf_dir):
    """Closes that are missing on days divisible by three; the price is there."""
    bars = region_bars(spark, sf_dir).unionByName(slot_bars(spark, sf_dir)).withColumn("price", F.col("close"))
    return rounded(B.quotes(bars.withColumn("close", F.when(F.dayofmonth("date") % 3 != 0, F.col("close"))), S), "price", "previous")


def slope_signs(spark, sf_dir):
    """The slope of a region's closes on the day of the year, by year, and which sign prevails."""
    bars = region_bars(spark, sf_dir).withColumn("year", F.year("date"))
    blocks = bars.groupBy("symbol", "year").agg(F.regr_slope("close", F.dayofyear("date")).alias("slope"), F.count("*").alias("n")).filter("n >= 3")
    return rounded(B.sign_summary(blocks, S, "slope"), "dominant_share")


def carried_components(spark, sf_dir):
    """At a region's last bar of a month, the slots whose last bar of that month is older."""
    last = lambda df, name: df.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.max("date").alias(name))
    slots = last(slot_bars(spark, sf_dir), "as_of").withColumnRenamed("symbol", "slot")
    return B.carried(last(region_bars(spark, sf_dir), "date").join(slots, "month"), ["symbol", "month"], "symbol", "slot")


def holder_totals(spark, sf_dir):
    """Suppliers of a nation as holders, every seventh a fund: what the others hold in all, and the fund with the lowest key."""
    s = table(spark, sf_dir, "supplier").withColumn("fund", F.col("s_suppkey") % 7 == 0)
    own = F.when(~F.col("fund"), cents(F.col("s_acctbal")))
    return s.groupBy("s_nationkey").agg(F.count(own).alias("private_rows"), F.coalesce(F.sum(own), F.lit(0)).alias("private_cents"), F.min(F.when(F.col("fund"), F.col("s_suppkey"))).alias("fund_row"))


def sub_periods(spark, sf_dir):
    return rounded(B.sub_periods(region_bars(spark, sf_dir), S, STARTS), "growth", "sd")


def path_summary(spark, sf_dir):
    """Closes as wealth by their number within a region; one region's tenth is missing."""
    path = region_bars(spark, sf_dir).withColumn("index", F.row_number().over(W.series(S))).withColumnRenamed("close", "wealth")
    out = B.path_summary(path.filter("symbol <> 'ASIA' or index <> 10"), S, 252)
    return rounded(out, "factor", "volatility", "drawdown", "annual_log")


QUERIES = {f.__name__: f for f in (report_order, declared_totals, newest_observation, file_freshness, quotes, slope_signs, carried_components, holder_totals, sub_periods, path_summary)}

ORACLES = {
    "report_order": """with f as (select o_custkey, o_orderkey as k, o_orderdate::date as d, strftime(last_day((o_orderdate::date - interval 2 month)::date), '%Y-%m-%d') as report from orders where o_orderkey % 4 <> 2 and o_orderkey % 9 <> 0)
select o_custkey, k as accession, k % 4 = 1 as amends, case when k % 3 = 0 then 'd' || k else 'primary_doc.xml' end as document,
row_number() over (partition by o_custkey order by report desc, (k % 4 = 1) desc, strftime(d, '%Y-%m-%d') || case when k % 5 <> 0 then 'T12' else '' end desc, k) as place from f""",
    "declared_totals": """with s as (select l_orderkey, count(*) as n0, sum(round(l_extendedprice * 100)::bigint)::bigint as t0 from lineitem group by 1),
d as (select l_orderkey, n0 + (l_orderkey % 97 = 0)::int as declared_n, t0 + (l_orderkey % 89 = 0)::int as declared_total, case when l_orderkey % 101 <> 0 then n0 else 0 end as n, case when l_orderkey % 101 <> 0 then t0 else 0 end as total from s)
select *, case when n <> declared_n and total <> declared_total then 'entries and value' when n <> declared_n then 'entries' else 'value' end as problem from d where n <> declared_n or total <> declared_total""",
    "newest_observation": """with o as (select o_custkey, o_orderdate::date as date, sum(round(o_totalprice * 100)::bigint)::double / 100 as nav from orders group by 1, 2),
d as (select o_custkey, (max(date) - (o_custkey % 3)::int)::date as date, arg_max(nav, date) as nav from o where o_custkey % 2 = 0 group by 1),
h as (select * from o where not exists (select 1 from d where d.o_custkey = o.o_custkey and d.date = o.date and d.o_custkey % 6 = 0)),
l as (select *, lead(nav) over (partition by o_custkey order by date desc) as before from h qualify row_number() over (partition by o_custkey order by date desc) = 1),
b as (select coalesce(d.o_custkey, l.o_custkey) as o_custkey, d.date as dd, d.nav as dn, l.date as ld, l.nav as ln, l.before, coalesce(l.date > d.date, d.date is null) as old from d full join l on d.o_custkey = l.o_custkey)
select o_custkey, case when old then ld else dd end as date, case when old then ln else dn end as nav, round(case when old then (ln / nullif(before, 0) - 1) * 100 else 0.5::double end, 6) as change,
case when old then 'historical' else 'daily' end as source, dd as daily_date, old and dd is not null as lags from b""",
    "file_freshness": f"""with {CAL_SQL}, o as (select o_orderkey, o_orderdate::date as d, o_orderdate::date + (o_orderkey % 11 - 4)::int as checked from orders),
n as (select date, lead(s) over (order by date) as nx from (select date, min(case when is_session then date end) over (order by date rows between current row and unbounded following) as s from cal))
select o_orderkey, checked::date as checked, (checked - d)::int as age, case when checked < d and d = nx then 'next' when checked < d then 'future' when checked - d > 5 then 'stale' else 'fresh' end as state from o left join n on n.date = o.checked""",
    "quotes": f"""with {REGION_SQL}, {SLOT_SQL}, b as (select * from region_bars union all select * from slot_bars),
v as (select symbol, close from b where day(date) % 3 <> 0 qualify row_number() over (partition by symbol order by date desc) = 2)
select b.symbol, round(arg_max(b.close, b.date), 6) as price, round(any_value(v.close), 6) as previous from b left join v on b.symbol = v.symbol group by 1""",
    "slope_signs": f"""with {REGION_SQL}, k as (select symbol, sign(coalesce(regr_slope(close, dayofyear(date)), 0)) as s from region_bars group by symbol, year(date) having count(*) >= 3),
c as (select symbol, count(*) as blocks, count(*) filter (s = 1) as positive, count(*) filter (s = -1) as negative, count(*) filter (s = 0) as zero from k group by 1)
select *, case when positive > negative then 'positive' when negative > positive then 'negative' end as dominant, round(case when positive = negative then 0 else greatest(positive, negative)::double / blocks end, 6) as dominant_share from c""",
    "carried_components": f"""with {REGION_SQL}, {SLOT_SQL}, r as (select symbol, date_trunc('month', date)::date as month, max(date) as date from region_bars group by 1, 2),
s as (select symbol as slot, date_trunc('month', date)::date as month, max(date) as as_of from slot_bars group by 1, 2)
select symbol, r.month, string_agg(symbol || '.' || slot || '@' || strftime(as_of, '%Y-%m-%d'), '; ' order by slot) as carried from r join s on r.month = s.month where as_of < date group by 1, 2""",
    "holder_totals": "select s_nationkey, count(*) filter (s_suppkey % 7 <> 0) as private_rows, coalesce(sum(round(s_acctbal * 100)::bigint) filter (s_suppkey % 7 <> 0), 0)::bigint as private_cents, min(s_suppkey) filter (s_suppkey % 7 = 0) as fund_row from supplier group by 1",
    "sub_periods": f"""with {REGION_SQL}, s as (select *, ln(close / lag(close) over (partition by symbol order by date)) as r from region_bars),
p as (select *, {" + ".join(f"(date >= date '{x}')::int" for x in STARTS)} as period from s where r is not null)
select symbol, period, min(date) as first, max(date) as last, count(*) as n, round(exp(sum(r)), 6) as growth, round(stddev_samp(r), 6) as sd from p group by 1, 2""",
    "path_summary": f"""with {REGION_SQL}, p as (select symbol, close as wealth, row_number() over (partition by symbol order by date) as i from region_bars qualify symbol <> 'ASIA' or i <> 10),
s as (select *, wealth / lag(wealth) over w - 1 as r, i - lag(i) over w as step, 1 - wealth / max(wealth) over (partition by symbol order by i rows unbounded preceding) as fall from p window w as (partition by symbol order by i)),
g as (select symbol, min(i) as first, max(i) as last, count(*) - 1 as intervals, arg_max(wealth, i) / arg_min(wealth, i) as f, stddev_samp(r) * sqrt(252.0) as v, max(fall) as d, bool_and(coalesce(step = 1, true)) as valid from s group by 1)
select symbol, first, last, intervals, round(f, 6) as factor, round(v, 6) as volatility, round(d, 6) as drawdown, valid, round(ln(f) * 252 / intervals, 6) as annual_log from g""",
}
