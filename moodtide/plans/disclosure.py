"""Holdings and filings: monthly snapshots of parts, their changes, identities, calendars and deadlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators import calendars as C, holdings as H, windows as W
from ..operators.lineage import stored
from ..sources.bars import REGION_SQL, cents, region_bars, table
from .sentiment import rounded


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, ticker, cusip (missing for some), shares, mv, units: what each part's order lines of a month add up to."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.trunc("l_shipdate", "month").alias("month"), "l_quantity", cents(F.col("l_extendedprice")).alias("c"))
    part = stored(lines.groupBy("month", "l_partkey").agg(F.sum("l_quantity").alias("shares"), (F.sum("c") / 100).alias("mv")))
    units = part.groupBy("month").agg((F.count("*") * 10.0).alias("units"))
    odd = F.pmod(F.col("l_partkey") + F.month("month"), F.lit(7)) == 0
    return part.join(F.broadcast(units), "month").select("month", F.concat(F.lit("P"), "l_partkey").alias("ticker"), F.when(~odd, F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("cusip"), "shares", "mv", "units")


SNAP_SQL = """part0 as (select date_trunc('month', l_shipdate)::date as month, l_partkey, sum(l_quantity) as shares, sum(round(l_extendedprice * 100)::bigint)::double / 100 as mv from lineitem group by 1, 2),
snaps as (select p.month, 'P' || l_partkey as ticker, case when (l_partkey + month(p.month)) % 7 <> 0 then lpad(l_partkey::varchar, 9, '0') end as cusip, shares, mv, u.units from part0 p join (select month, count(*) * 10.0::double as units from part0 group by 1) u on p.month = u.month)"""


def holdings_changes(spark, sf_dir):
    """Every month against the one before it."""
    s = snapshots(spark, sf_dir)
    units = s.groupBy(F.col("month").alias("to_month")).agg(F.first("units").alias("units_to"))
    old = units.select(F.add_months("to_month", 1).alias("to_month"), F.col("units_to").alias("units_from"))
    both = units.join(old, "to_month")  # a row a month
    columns = ["ticker", "cusip", "shares", "mv"]
    before = s.select(F.add_months("month", 1).alias("to_month"), *columns).join(F.broadcast(both.select("to_month")), "to_month")
    after = s.select(F.col("month").alias("to_month"), *columns).join(F.broadcast(both.select("to_month")), "to_month")
    pairs = H.matched(before, after, ["to_month"], "cusip", "ticker")
    changes = H.changes(pairs.join(F.broadcast(both), "to_month"), F.col("units_from"), F.col("units_to"))
    return changes.select("to_month", F.coalesce("ticker_to", "ticker_from").alias("ticker"), "kind", "delta", "expected", "value")


def trade_entries(spark, sf_dir):
    """Per month how many changes of each kind, and the three largest as text."""
    c = stored(holdings_changes(spark, sf_dir).select("to_month", "ticker", "kind", "value"))
    place = F.row_number().over(W.Window.partitionBy("to_month").orderBy(F.desc("value"), "ticker"))
    first = c.withColumn("place", place).filter("place <= 3")  # each task hands on three rows a month
    top = F.sort_array(F.collect_list(F.struct("place", F.concat_ws(" ", "kind", "ticker").alias("t"))))
    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(k.lower().replace(" ", "_")) for k in ("NEW", "SOLD OUT", "INCREASE", "DECREASE")]
    largest = first.groupBy("to_month").agg(F.array_join(F.transform(top, lambda x: x["t"]), "; ").alias("largest"))
    return c.groupBy("to_month").agg(*kinds).join(largest, "to_month")


def filing_changes(spark, sf_dir):
    """Quarters of parts by line status as filings: every quarter against the one before."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", F.trunc("l_shipdate", "quarter").alias("quarter"), "l_quantity", cents(F.col("l_extendedprice")).alias("c"))
    rows = lines.groupBy("quarter", F.concat_ws("|", "l_partkey", "l_linestatus").alias("key")).agg((F.sum("l_quantity") * 100).alias("shares"), (F.sum("c") / 100).alias("value"))
    last = rows.agg(F.max("quarter").alias("last"))
    previous = rows.withColumn("quarter", F.add_months("quarter", 3)).crossJoin(F.broadcast(last)).filter("quarter <= last").drop("last")
    out = H.quarter_on_quarter(rows, previous, ["quarter", "key"])
    return out.groupBy("quarter", "change").agg(F.count("*").alias("n"), F.sum("shares").alias("shares"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / 100, 2).alias("value"))


def entity_resolution(spark, sf_dir):
    """Parts against a list of themselves in which a third of the ids are lost and another third is in another form."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    filed = part.select(k.alias("a"), F.when(k % 3 == 0, F.lpad(k.cast("string"), 9, "0")).alias("cusip"), F.when(k % 3 == 1, F.concat(F.lit("US"), F.lpad(k.cast("string"), 9, "0"), F.lit("0"))).alias("isin"), F.concat_ws(" ", "p_brand", "p_partkey", "p_name").alias("name"))
    held = part.select(k.alias("b"), F.lpad(k.cast("string"), 9, "0").alias("id"), F.concat_ws("-", F.upper("p_brand"), "p_partkey", "p_type").alias("label")).filter("b % 5 != 0")
    key = lambda c: F.concat_ws(" ", F.slice(F.filter(F.split(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "), " "), lambda w: w != ""), 1, 3))
    return H.resolved(filed, held, "a", "b", [("cusip", F.col("cusip"), F.col("id"), False), ("isin", F.substring("isin", 3, 9), F.col("id"), False), ("name", key("name"), key("label"), True)])


def calendar_days(spark, sf_dir):
    c = C.calendar(spark, "1994-12-01", "2024-12-31")
    return c.filter("date between '1995-01-01' and '2023-12-31' and (holiday is not null or (not is_weekend and not is_session))").select("date", "holiday", "is_session", "business_day", "next_session")


def filing_deadlines(spark, sf_dir):
    quarters = spark.sql("select explode(sequence(date'1995-03-31', date'2022-12-31', interval 3 months)) as d").select(F.last_day("d").alias("report"))
    out = C.deadlines(quarters, C.calendar(spark, "1995-01-01", "2024-12-31"), "report", 45)
    return out.select("report", "quarter_end", "due", "deadline", "rolled")


def missing_sessions(spark, sf_dir):
    """Sessions between a region's first and last bar on which it has none, by year; and bars on days that are none."""
    bars = region_bars(spark, sf_dir).select("symbol", "date")
    first, last = bars.agg(F.min("date"), F.max("date")).first()
    if first is None:
        return bars.select("symbol", F.year("date").alias("year"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("n"))
    sessions = C.calendar(spark, str(first), str(last)).filter("is_session").select("date")
    spans = bars.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    expected = spans.select("symbol", F.explode(F.sequence("first", "last")).alias("date")).join(sessions, "date", "left_semi").select("symbol", "date")
    missing = expected.join(bars, ["symbol", "date"], "left_anti").withColumn("kind", F.lit("missing"))
    odd = bars.join(sessions, "date", "left_anti").withColumn("kind", F.lit("unexpected"))
    return missing.unionByName(odd).groupBy("symbol", F.year("date").alias("year"), "kind").agg(F.count("*").alias("n"))


def roll_chains(spark, sf_dir):
    """Orders of a customer as bills that are rolled into the next one if it comes within 60 days: chains of at least three."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), cents(F.col("o_totalprice")).alias("c"))
    daily = orders.groupBy("o_custkey", "date").agg((1 + F.pmod(F.sum("c"), F.lit(1000)) / 100000).alias("growth"))
    steps = daily.withColumn("next", F.lead("date").over(W.series(["o_custkey"])))
    name = lambda c: F.concat_ws("@", "o_custkey", c)
    bills = steps.withColumn("end", F.when(F.datediff("next", "date") <= 60, name("next")).otherwise(F.concat(name("date"), F.lit("+")))).withColumn("start", name("date"))
    return rounded(H.chains(bills, "start", "end", "growth").filter("length >= 3").select("first", "last", "length", "product"), "product")


def latest_versions(spark, sf_dir):
    """Of each customer and quarter the order with the latest date, then the highest key: later filings replace earlier ones."""
    orders = table(spark, sf_dir, "orders").withColumn("quarter", F.trunc("o_orderdate", "quarter"))
    return H.latest(orders, ["o_custkey", "quarter"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "quarter", "o_orderkey")


def changed_observations(spark, sf_dir):
    """Order states of a customer that differ from the one before."""
    orders = table(spark, sf_dir, "orders").withColumn("at", F.concat_ws("/", F.date_format("o_orderdate", "yyyy-MM-dd"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    return H.changed_only(orders, ["o_custkey"], "at", ["o_orderstatus"]).select("o_custkey", "o_orderkey", "o_orderstatus")


def nav_proofs(spark, sf_dir):
    """Supplier balances as files of net assets, with their nation's mean balance as NAV."""
    s = table(spark, sf_dir, "supplier").withColumn("units", (F.col("s_suppkey") % 50 + 1).cast("double")).withColumn("nav", F.abs("s_acctbal") / 100 + 1)
    files = s.withColumn("net", F.floor(F.col("nav") * 100 + 0.5) / 100 * F.col("units") + F.when(F.col("s_suppkey") % 4 == 0, 7.77).otherwise(0.0))
    proof = H.nav_proof(F.col("net"), F.col("units"), F.col("nav"), F.when(F.col("s_suppkey") % 3 != 0, F.col("units")), (F.col("s_suppkey") % 6).cast("int"))
    return files.select("s_suppkey", proof.alias("proof"), H.implied_units(F.col("net"), F.col("nav")).cast("double").alias("units"))


def parsed_texts(spark, sf_dir):
    """Numbers and dates made from orders as filings write them, read back."""
    o = table(spark, sf_dir, "orders")
    price, day = F.col("o_totalprice"), F.to_date("o_orderdate")
    us = F.concat(F.lit("$"), F.format_number(price, 2))
    return o.select(
        "o_orderkey", texts.strict_number(F.when(F.col("o_orderkey") % 2 == 0, us).otherwise(F.concat(F.lit("("), us, F.lit(")"))), negative=True).alias("amount"),
        texts.us_date(F.date_format(day, "MM/dd/yyyy")).alias("us"), texts.sec_date(F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "MM-dd-yyyy"))).alias("sec"),
        texts.turkish_number(F.translate(F.format_number(price, 2), ",.", ".,")).alias("turkish"), texts.kap_date(F.date_format(day, "dd/MM/yyyy HH:mm:ss")).alias("kap"), texts.cik(F.col("o_custkey").cast("string")).alias("cik"),
    )


QUERIES = {f.__name__: f for f in (holdings_changes, trade_entries, filing_changes, entity_resolution, calendar_days, filing_deadlines, missing_sessions, roll_chains, latest_versions, changed_observations, nav_proofs, parsed_texts)}


def _observed(m: int, d: int) -> str:
    at = lambda x: f"(month({x}) = {m} and day({x}) = {d})"
    return f"(({at('date')} and dayofweek(date) not in (0, 6)) or (dayofweek(date) = 5 and {at('date + 1')}) or (dayofweek(date) = 1 and {at('date - 1')}))"


def _nth(m: int, w: int, n: int) -> str:
    return f"(month(date) = {m} and dayofweek(date) = {w} and (day(date) + 6) // 7 = {n})"


MEMORIAL = "(month(date) = 5 and dayofweek(date) = 1 and month(date + 7) = 6)"
# Easter by another rule than the operator's: the first Sunday after the ecclesiastical full moon, from the century's epact
EASTER = """easter as (select y, (make_date(y::int, 3, 21) + d::int + 7 - dayofweek(make_date(y::int, 3, 21) + d::int)::int)::date as e from (
  select y, case when d0 = 29 then 28 when d0 = 28 and g > 10 then 27 else d0 end as d from (select y, y % 19 as g, (19 * (y % 19) + (y // 100) - (y // 400) - ((8 * (y // 100) + 13) // 25) + 15) % 30 as d0 from range(1990, 2030) t(y))))"""
CAL_SQL = f"""{EASTER}, base as (select d::date as date from generate_series(date '1994-12-01', date '2024-12-31', interval 1 day) t(d)),
cal as (select date, dayofweek(date) in (0, 6) as weekend,
  case when {_observed(1, 1)} then 'New Year''s Day' when {_nth(1, 1, 3)} then 'Martin Luther King Jr. Day' when {_nth(2, 1, 3)} then 'Presidents'' Day' when {MEMORIAL} then 'Memorial Day' when {_observed(6, 19)} then 'Juneteenth'
    when {_observed(7, 4)} then 'Independence Day' when {_nth(9, 1, 1)} then 'Labor Day' when {_nth(10, 1, 2)} then 'Columbus Day' when {_observed(11, 11)} then 'Veterans Day' when {_nth(11, 4, 4)} then 'Thanksgiving Day' when {_observed(12, 25)} then 'Christmas Day' end as holiday,
  not (dayofweek(date) in (0, 6) or (month(date) = 1 and {_observed(1, 1)}) or {_nth(2, 1, 3)} or {MEMORIAL} or {_observed(7, 4)} or {_nth(9, 1, 1)} or {_nth(11, 4, 4)} or {_observed(12, 25)} or (year(date) >= 1998 and {_nth(1, 1, 3)}) or (year(date) >= 2022 and {_observed(6, 19)}) or date + 2 = e) as is_session
  from base left join easter on y = year(date))"""

ORACLES = {
    "holdings_changes": f"""with {SNAP_SQL}, m as (select distinct month from snaps), t as (select a.month as to_month from m a join m b on b.month = a.month - interval 1 month),
o as (select t.to_month, s.* from snaps s join t on s.month = t.to_month - interval 1 month), w as (select t.to_month, s.* from snaps s join t on s.month = t.to_month),
c as (select w.to_month, o.ticker as tf, w.ticker as tt, o.shares as sf, w.shares as st, o.mv as mf, w.mv as mt from w join o on w.to_month = o.to_month and w.cusip = o.cusip),
r as (select coalesce(a.to_month, b.to_month) as to_month, b.ticker as tf, a.ticker as tt, b.shares as sf, a.shares as st, b.mv as mf, a.mv as mt
  from (select * from w where not exists (select 1 from c where c.to_month = w.to_month and c.tt = w.ticker)) a full join (select * from o where not exists (select 1 from c where c.to_month = o.to_month and c.tf = o.ticker)) b on a.to_month = b.to_month and a.ticker = b.ticker),
u as (select distinct month, units from snaps), x as (select p.*, n.units as ut, f.units as uf, coalesce(st, 0) - coalesce(sf, 0) as delta from (select * from c union all select * from r) p join u n on n.month = p.to_month join u f on f.month = p.to_month - interval 1 month),
y as (select *, case when sf is not null and st is not null and ut <> uf then sf * ut / uf end as expected from x)
select to_month, coalesce(tt, tf) as ticker, case when sf is null then 'NEW' when st is null then 'SOLD OUT' when delta > 0 then 'INCREASE' else 'DECREASE' end as kind, delta, expected, abs(delta) * coalesce(case when st <> 0 then mt / st end, case when sf <> 0 then mf / sf end, 0) as value
from y where abs(delta) >= 0.5 and not coalesce(abs(st - expected) <= greatest(0.5, abs(delta) * 0.005), false)""",
    "filing_changes": """with q as (select date_trunc('quarter', l_shipdate)::date as quarter, l_partkey || '|' || l_linestatus as key, sum(l_quantity) * 100 as shares, sum(round(l_extendedprice * 100)::bigint) as c from lineitem group by 1, 2),
j as (select coalesce(a.quarter, (b.quarter + interval 3 month)::date) as quarter, coalesce(a.shares, 0) as s, coalesce(a.c, 0) as c, b.shares as ps from q a full join (select * from q where quarter < (select max(quarter) from q)) b on a.key = b.key and a.quarter = b.quarter + interval 3 month)
select quarter, case when ps is null then case when s > 0 and s < 10000 and c / 100 < 200000 then 'first reported' else 'new' end when s = 0 then 'no longer reported' when s > ps then 'increase' when s < ps then 'decrease' else 'unchanged' end as change, count(*) as n, sum(s) as shares, round(sum(c)::double / 100, 2) as value from j group by 1, 2""",
    "entity_resolution": "select p_partkey as a_id, p_partkey as b_id, case p_partkey % 3 when 0 then 'cusip' when 1 then 'isin' else 'name' end as method from part where p_partkey % 5 <> 0",
    "calendar_days": f"""with {CAL_SQL} select date, holiday, is_session, (select min(date) from cal b where b.date >= a.date and not weekend and holiday is null) as business_day, (select min(date) from cal b where b.date > a.date and is_session) as next_session
from cal a where date between date '1995-01-01' and date '2023-12-31' and (holiday is not null or (not weekend and not is_session))""",
    "filing_deadlines": f"""with {CAL_SQL}, q as (select (date_trunc('quarter', d) + interval 3 month - interval 1 day)::date as report from generate_series(date '1995-01-01', date '2022-10-01', interval 3 month) t(d)),
e as (select report, (date_trunc('quarter', report) + interval 6 month - interval 1 day)::date as quarter_end from q), r as (select *, quarter_end + 45 as due from e)
select *, deadline <> due as rolled from (select *, (select min(date) from cal where date >= due and not weekend and holiday is null) as deadline from r)""",
    "missing_sessions": f"""with {REGION_SQL}, {CAL_SQL}, s as (select symbol, min(date) as f, max(date) as l from region_bars group by 1)
select symbol, year(date) as year, kind, count(*) as n from (select symbol, date, 'missing' as kind from cal, s where is_session and date between f and l and not exists (select 1 from region_bars r where r.symbol = s.symbol and r.date = cal.date)
union all select symbol, date, 'unexpected' from region_bars where date not in (select date from cal where is_session)) group by 1, 2, 3""",
    "roll_chains": """with d as (select o_custkey, o_orderdate::date as date, 1 + (sum(round(o_totalprice * 100)::bigint) % 1000)::double / 100000 as growth from orders group by 1, 2),
g as (select *, coalesce(date - lag(date) over w > 60, true) as head, lead(date) over w as nxt from d window w as (partition by o_custkey order by date)), c as (select *, sum(head::int) over (partition by o_custkey order by date) as chain from g)
select o_custkey || '@' || min(date) as first, o_custkey || '@' || max(date) || '+' as last, count(*) as length, round(product(growth), 6) as product from c group by o_custkey, chain having count(*) >= 3""",
    "latest_versions": "select o_custkey, date_trunc('quarter', o_orderdate)::date as quarter, o_orderkey from orders qualify row_number() over (partition by o_custkey, date_trunc('quarter', o_orderdate) order by o_orderdate desc, o_orderkey desc) = 1",
    "changed_observations": "select o_custkey, o_orderkey, o_orderstatus from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate::date, o_orderkey) as b from orders) where b is distinct from o_orderstatus",
    "nav_proofs": """with s as (select s_suppkey, (s_suppkey % 50 + 1)::double as units, floor((abs(s_acctbal) / 100 + 1) * 100 + 0.5) / 100 as nav from supplier), f as (select *, nav * units + case when s_suppkey % 4 = 0 then 7.77::double else 0 end as net, s_suppkey % 6 as gap from s)
select s_suppkey, case when gap <= 4 and abs(net - nav * units) <= greatest(1, abs(net) * 1e-5) then 'exact' when gap <= 4 and abs(net / units - nav) <= 0.005 then 'per-share' end as proof,
case when floor(net / nav + 0.5) > 0 and abs(net / nav - floor(net / nav + 0.5)) <= greatest(0.01::double / nav, 1e-6) then floor(net / nav + 0.5)::double end as units from f""",
    "parsed_texts": "select o_orderkey, case when o_orderkey % 2 = 0 then round(o_totalprice, 2) else -round(o_totalprice, 2) end as amount, o_orderdate::date as us, o_orderdate::date as sec, round(o_totalprice, 2) as turkish, o_orderdate::date as kap, lpad(o_custkey::varchar, 10, '0') as cik from orders",
}
ORACLES["trade_entries"] = f"""with c as ({ORACLES["holdings_changes"]}), r as (select *, row_number() over (partition by to_month order by value desc, ticker) as place from c)
select to_month, count(*) filter (kind = 'NEW') as new, count(*) filter (kind = 'SOLD OUT') as sold_out, count(*) filter (kind = 'INCREASE') as increase, count(*) filter (kind = 'DECREASE') as decrease, string_agg(kind || ' ' || ticker, '; ' order by place) filter (place <= 3) as largest from r group by 1"""
