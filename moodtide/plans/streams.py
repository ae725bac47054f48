"""What streams give, as tables: bundles of decisions and breaks of a chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.bars import REGION_SQL, cents, region_bars
from ..streaming import bundles as B, ledger as L
from .outcomes import SCORE_SQL, momentum_scores

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def decision_bundles(spark, sf_dir):
    """The regions' bundles: days that only some of them have are missed."""
    sessions = momentum_scores(spark, sf_dir).select(F.lit("world").alias("panel"), F.col("symbol").alias("market"), "date", F.round("score", 6).alias("score"))
    # sessions that the data lack by rule, so that bundles are held back
    return B.bundles(sessions.filter("not (market = 'ASIA' and day(date) = 13) and not (market = 'EUROPE' and dayofweek(date) = 2)"), REGIONS).withColumn("date", F.to_date("date"))


def chain_breaks(spark, sf_dir):
    """Entries of a ledger that don't follow from what was recorded, after some closes were changed, and gaps of more than three days."""
    bars = region_bars(spark, sf_dir).select("symbol", "date", cents(F.col("close")).alias("c"))
    chain = L.chained(bars, ["symbol"], "date", ["date", "c"])
    spoilt = chain.withColumn("c", F.when(F.dayofmonth("date") == 13, F.col("c") + 1).otherwise(F.col("c")))
    return L.broken(spoilt, ["symbol"], "date", ["date", "c"], 3).select("symbol", "date", "problem", "gap")


QUERIES = {f.__name__: f for f in (decision_bundles, chain_breaks)}

ORACLES = {
    "decision_bundles": f"""with recursive {SCORE_SQL}, s as (select symbol, date, floor(floor(round(score, 6) * 10 + 0.5) / 10 + 0.5) as shown from scored where not (symbol = 'ASIA' and day(date) = 13) and not (symbol = 'EUROPE' and dayofweek(date) = 1)),
d as (select date, count(*) as n from s group by 1), p as (select s.*, coalesce(last_value(case when shown >= 75 then 0 when shown <= 25 then 1 end ignore nulls) over (partition by symbol order by date), 1) as pos from s join d using (date) where n = 5),
h as (select date, string_agg(symbol || ':' || pos, ',' order by symbol) as positions from p group by 1), m as (select date, n, sum(case when n < 5 then n else 0 end) over (order by date) as u from d),
b as materialized (select date, positions, (u - coalesce(lag(u) over (order by date), 0))::bigint as missed, row_number() over (order by date) as k from m join h using (date) where n = 5),
c as (select k, date, positions, missed, sha256('world') as previous, sha256(date || '|' || positions || '|' || missed || '|' || sha256('world')) as digest from b where k = 1
  union all select b.k, b.date, b.positions, b.missed, c.digest, sha256(b.date || '|' || b.positions || '|' || b.missed || '|' || c.digest) from c join b on b.k = c.k + 1)
select 'world' as panel, date, positions, missed, previous, digest from c""",
    "chain_breaks": f"""with {REGION_SQL}, g as (select symbol, date, lag(date) over w as before, date - lag(date) over w as gap from region_bars window w as (partition by symbol order by date))
select symbol, date, case when day(date) = 13 or day(before) = 13 then 'chain' else 'gap' end as problem, gap from g where day(date) = 13 or day(before) = 13 or gap > 3""",
}
