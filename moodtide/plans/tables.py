"""Files written from the test tables and read again by the names in their headers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.lineage import folder
from ..sources import tables as R
from ..sources.bars import SLOT_SQL, cents, slot_bars, table

_QUOTED = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "true"}


def _written(spark, rows):
    path = f"{folder(spark)}/table-{uuid.uuid4().hex}"
    rows.write.options(**_QUOTED).csv(path)
    return path


def _holdings(spark, sf_dir):
    """Suppliers of a nation as holdings of a day, with numbers as such files have them; by nation some rows are wrong."""
    s = table(spark, sf_dir, "supplier").withColumn("v", cents(F.abs("s_acctbal")) % 1000 + 1)
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    total = s.groupBy("s_nationkey").agg(F.sum("v").alias("t"))
    x = s.join(total, "s_nationkey").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), n))
    rows = x.select(
        F.format_number("v", 2).alias("MarketValue"), F.date_format("day", "MM/dd/yyyy").alias("Date"), F.when((n == 3) & (k % 2 == 0), "B").otherwise("A").alias("Account"),
        F.when(n == 4, "SAME").otherwise(F.concat(F.lit("T"), k)).alias("StockTicker"), F.lpad(k.cast("string"), 9, "0").alias("CUSIP"), F.concat(F.lit('Name, "'), k, F.lit('"\nInc')).alias("SecurityName"),
        F.when(n == 5, "n/a").otherwise(F.concat(F.lit("("), (k + 1).cast("string"), F.lit(")"))).alias("Shares"), F.lit("$1.50").alias("Price"), F.concat(F.round(F.col("v") / F.col("t") * F.when(n == 6, 120).otherwise(100), 6).cast("string"), F.lit("%")).alias("Weightings"),
        F.format_number(F.col("t") * F.when(n == 7, 2).otherwise(1), 0).alias("NetAssets"), F.lit("100").alias("SharesOutstanding"),
    )
    return R.holdings(spark, _written(spark, rows))


def snapshot_checks(spark, sf_dir):
    """What is wrong with the holdings of each day, read from quoted files with line ends in fields."""
    rows, _ = _holdings(spark, sf_dir)
    return R.snapshot_problems(rows)


def holdings_rows(spark, sf_dir):
    """The holdings as read."""
    rows, _ = _holdings(spark, sf_dir)
    return rows.select("date", "account", "ticker", "cusip", F.length("name").alias("name_length"), "shares", "price", "value", "net")


def stress_index(spark, sf_dir):
    """A gauge's file read by the names of its columns, among others in another order, up to a date; a dot is no value."""
    bars = slot_bars(spark, sf_dir).filter("symbol in ('A', 'N', 'R')").groupBy("date").pivot("symbol", ["A", "N", "R"]).agg(F.first("close"))
    text = lambda c, gap: F.when(F.dayofmonth("date") % gap == 0, ".").otherwise(F.coalesce(F.format_string("%.4f", c), F.lit("")))
    rows = bars.select(text(F.col("R"), 7).alias("Volatility"), F.col("date").cast("string").alias("Date"), F.lit("x").alias("Note, of no use"), text(F.col("A"), 5).alias("OFR FSI"))
    read, _ = R.dated(spark, _written(spark, rows), {"date": "Date", "index": "OFR FSI", "volatility": "Volatility"}, as_of="2000-12-31")
    return read


def nav_history(spark, sf_dir):
    """Daily values with the units that the history has for the same date and value."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg((F.sum(cents(F.col("o_totalprice"))) % 10000 / 100).alias("v"), F.count("*").alias("u"))
    day = F.date_format("d", "MM/dd/yyyy")
    daily = o.select(day.alias("As Of"), F.format_string("%.2f", "v").alias("NAV"), F.when(F.col("u") % 3 == 0, F.col("u").cast("string")).otherwise("").alias("Units"))
    history = o.filter("day(d) <> 4").select(F.col("u").cast("string").alias("Units"), F.format_string("%.2f", F.col("v") + F.when(F.dayofmonth("d") == 9, 1).otherwise(0)).alias("NAV"), F.format_string("%d", F.col("u") * 7).alias("Net Assets"), day.alias("Date"))
    one, _ = R.dated(spark, _written(spark, daily), {"date": "As Of", "nav": "NAV", "units": "Units"})
    other, _ = R.dated(spark, _written(spark, history), {"date": "Date", "nav": "NAV", "units": "Units", "net_assets": "Net Assets"})
    return R.merged_nav(one, other)


QUERIES = {f.__name__: f for f in (snapshot_checks, holdings_rows, stress_index, nav_history)}

_ROWS = "x as (select *, s_suppkey as k, s_nationkey as n, round(abs(s_acctbal) * 100)::bigint % 1000 + 1 as v, sum(round(abs(s_acctbal) * 100)::bigint % 1000 + 1) over (partition by s_nationkey) as t, count(*) over (partition by s_nationkey) as m, date '2020-01-01' + s_nationkey::int as date from supplier)"
ORACLES = {
    "snapshot_checks": f"""with {_ROWS}, g as (select n, date, count(*) as m, count(*) filter (k % 2 = 0) as e from x group by 1, 2),
u as (select date, unnest([case when n = 4 and m > 1 then 'repeated ticker' end, case when n = 3 and e between 1 and m - 1 then 'several accounts' end, case when n = 6 then 'weights' end, case when n = 7 then 'values' end, case when n = 5 then 'no number' end]) as problem from g)
select * from u where problem is not null""",
    "holdings_rows": f"""with {_ROWS} select date, case when n = 3 and k % 2 = 0 then 'B' else 'A' end as account, case when n = 4 then 'SAME' else 'T' || k end as ticker, nullif(lpad(k::varchar, 9, '0'), '000000000') as cusip, length('Name, "' || k || '"' || chr(10) || 'Inc') as name_length,
case when n <> 5 then -(k + 1)::double end as shares, 1.5::double as price, v::double as value, (t * case when n = 7 then 2 else 1 end)::double as net from x""",
    "stress_index": f"""with {SLOT_SQL}, p as (select date, max(close) filter (symbol = 'A') as a, max(close) filter (symbol = 'R') as r from slot_bars where symbol in ('A', 'N', 'R') group by 1),
q as (select date, case when day(date) % 5 <> 0 then round(a, 4) end as index, case when day(date) % 7 <> 0 then round(r, 4) end as volatility from p) select * from q where coalesce(index, volatility) is not null and date <= date '2000-12-31'""",
    "nav_history": """with o as (select o_orderdate::date as date, (sum(round(o_totalprice * 100)::bigint) % 10000)::double / 100 as nav, count(*)::double as u from orders group by 1)
select date, nav, case when u % 3 = 0 or day(date) not in (4, 9) then u end as units, case when day(date) not in (4, 9) then u * 7 end as net_assets from o""",
}
