"""Forecasts, resampling, the ledger, and readers held against the rows their documents were made from."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M, outcomes as O, windows as W
from ..sources import filings as R
from ..sources.bars import REGION_SQL, cents, region_bars, table
from ..streaming import ledger as L
from .outcomes import SCORE_SQL, momentum_scores
from .sentiment import label_sql, rounded

S = ["symbol"]
PRICE = ["log1", "log5", "log20", "vol20", "trend"]


def learner_rows(spark, sf_dir):
    scores = momentum_scores(spark, sf_dir)
    features = O.learner_features(scores, S)
    label = O.forward_returns(scores.select("symbol", "date", "close"), S, (1,)).select("symbol", "date", "label")
    return features.join(label, ["symbol", "date"])


def prequential_decisions(spark, sf_dir):
    out = M.prequential(learner_rows(spark, sf_dir), S, [*PRICE, "centre", "square", "d1", "d5", "d21", "interaction"], "label", 0.0025)
    return rounded(out.select("symbol", "date", "n_known", "forecast", "reason", "target"), "forecast")


def least_squares(spark, sf_dir):
    """The next log return on the last one, by region."""
    out = M.least_squares(learner_rows(spark, sf_dir).select("symbol", "log1", "label"), S, ["log1"], "label")
    return rounded(out, "coefficient")


def weighted_least_squares(spark, sf_dir):
    """The same over all regions, each region weighing the same."""
    rows = learner_rows(spark, sf_dir).select("symbol", "log1", "label").dropna()
    weighed = rows.withColumn("w", 1 / F.count("*").over(W.Window.partitionBy("symbol"))).withColumn("k", F.lit("all"))
    return rounded(M.least_squares(weighed, ["k"], ["log1"], "label", weight="w"), "coefficient")


def residual_pls(spark, sf_dir):
    """What scores add to price features for the next log return."""
    return rounded(M.residual_pls(learner_rows(spark, sf_dir), S, PRICE, ["centre", "square", "d1", "d5", "d21"], "label"), "coefficient")


def monthly_progress(spark, sf_dir):
    """The last score of each completed month, its label, and how many days of fear and greed it had."""
    from ..functions.numbers import displayed, label

    scores = momentum_scores(spark, sf_dir).filter("score is not null").withColumn("month", F.trunc("date", "month")).withColumn("score", F.round("score", 6))
    shown = displayed(F.col("score"))
    months = scores.groupBy("symbol", "month").agg(F.max_by("score", "date").alias("score"), F.count(F.when(shown <= 24, 1)).alias("fear"), F.count(F.when(shown >= 75, 1)).alias("greed"))
    open_ = F.max("month").over(W.Window.partitionBy("symbol"))
    return months.withColumn("open", open_).filter("month < open").drop("open").withColumn("label", label(F.col("score")))


def block_bootstrap(spark, sf_dir):
    months = O.monthly_variance(region_bars(spark, sf_dir).withColumn("r", W.log_return(F.col("close"), S)), S).select("symbol", F.col("month").alias("date"), F.log("variance").alias("v"))
    return rounded(M.block_bootstrap(months, S, "v", 6, 2000, 20260825), "low", "median", "high", "share_below")


def asset_rotation(spark, sf_dir):
    """Between the two regions with the highest and lowest names, each month into the one that rose more over 252 bars."""
    bars = region_bars(spark, sf_dir).filter("symbol in ('AFRICA', 'MIDDLE EAST')")
    both = bars.groupBy("date").pivot("symbol", ["AFRICA", "MIDDLE EAST"]).agg(F.first("close")).dropna().select("date", F.pow("AFRICA", 0.025).alias("a"), F.pow("MIDDLE EAST", 0.025).alias("b")).withColumn("k", F.lit("pair"))
    rise = lambda c: F.col(c) / F.lag(c, 252).over(W.series(["k"]))
    end = F.trunc(F.lead("date").over(W.series(["k"])), "month") != F.trunc("date", "month")
    pick = F.when(end & rise("a").isNotNull(), (rise("a") >= rise("b")).cast("double"))
    rows = both.withColumn("w_a", pick).withColumn("w_b", 1 - F.col("w_a"))
    return rounded(M.rotation(rows, ["k"], ["a", "b"], 0.002), "wealth")


def entries(spark, sf_dir):
    """Order states of customers as ledger entries: the first of a day counts."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_orderstatus", cents(F.col("o_totalprice")).alias("cents"))
    return L.first_wins(o, ["o_custkey", "date"], ["o_orderkey"])


def ledger_chain(spark, sf_dir):
    c = L.chained(entries(spark, sf_dir), ["o_custkey"], "date", ["date", "o_orderkey", "o_orderstatus", "cents"])
    return c.select("o_custkey", "date", "digest", "previous", "gap")


def ledger_events(spark, sf_dir):
    bars = region_bars(spark, sf_dir)
    return L.matured(bars, S).select("symbol", "date", "kind", "at", F.round("value", 6).alias("value"))


def ledger_endpoint(spark, sf_dir):
    e = L.endpoint(region_bars(spark, sf_dir), S)
    return e.groupBy("symbol", "complete").agg(F.count("*").alias("n"), F.max("date").alias("last"))


def chart_round_trip(spark, sf_dir):
    """Region bars written as chart documents, with a wrong symbol among them, and read again."""
    bars = region_bars(spark, sf_dir)
    noon = F.unix_timestamp(F.col("date").cast("timestamp")) + 43200
    listed = bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(noon.alias("at"), "close"))).alias("v"))
    doc = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.when(F.col("symbol") == "ASIA", "OTHER").otherwise(F.col("symbol")).alias("symbol"), F.lit("UTC").alias("exchangeTimezoneName")).alias("meta"), F.col("v.at").alias("timestamp"), F.struct(F.array(F.struct(F.col("v.close").alias("close"))).alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    return rounded(R.chart_bars(listed.select("symbol", doc.alias("payload"))), "close")


def information_table(spark, sf_dir):
    """Parts' order lines as rows of an information table in XML, read again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("q"), F.sum(cents(F.col("l_extendedprice"))).alias("c"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    xml = tag("infoTable", F.concat(tag("nameOfIssuer", F.concat(F.lit("PART "), "l_partkey")), tag("titleOfClass", F.lit("COM")), tag("cusip", F.lpad(F.col("l_partkey").cast("string"), 9, "A")), tag("value", F.col("c")), tag("shrsOrPrnAmt", F.concat(tag("sshPrnamt", F.col("q")), tag("sshPrnamtType", F.lit("SH")))), F.when(F.col("l_linestatus") == "F", tag("putCall", F.lit("Put"))).otherwise(""), tag("votingAuthority", F.concat(tag("Sole", F.col("q")), tag("Shared", F.lit(0)), tag("None", F.lit(0))))))
    return R.information_rows(lines.select(xml.alias("xml"))).select("issuer", "cusip", "value", "shares", "put_call", "sole")


def filing_list(spark, sf_dir):
    """Orders as columnar filing documents of their customers, those of one form read again."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.col("o_orderkey").cast("string").alias("a"), F.when(F.col("o_orderstatus") == "F", "13F-HR").otherwise("8-K").alias("b"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("c")).alias("v"))
    listed = o.groupBy("o_custkey").agg(F.collect_list("v").alias("v"))
    doc = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.struct(F.struct(F.col("v.a").alias("accessionNumber"), F.col("v.b").alias("form"), F.col("v.c").alias("filingDate"), F.col("v.c").alias("reportDate"), F.col("v.c").alias("acceptanceDateTime")).alias("recent")).alias("filings")))
    return R.submissions(listed.select(doc.alias("payload"))).select("cik", "accession", "form", "filed", "report")


def page_fields(spark, sf_dir):
    return R.page_fields(table(spark, sf_dir, "pages"))


def event_props(spark, sf_dir):
    return R.event_props(table(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (prequential_decisions, least_squares, weighted_least_squares, residual_pls, monthly_progress, block_bootstrap, asset_rotation, ledger_chain, ledger_events, ledger_endpoint, chart_round_trip, information_table, filing_list, page_fields, event_props)}

ENTRY_SQL = "entries as (select o_custkey, o_orderdate::date as date, o_orderkey, o_orderstatus, round(o_totalprice * 100)::bigint as cents from orders qualify row_number() over (partition by o_custkey, o_orderdate::date order by o_orderkey) = 1)"
ORACLES = {
    "weighted_least_squares": f"""with {REGION_SQL}, r as (select symbol, ln(close / lag(close) over w) as x, ln(lead(close, 2) over w / lead(close, 1) over w) as y from region_bars window w as (partition by symbol order by date)),
w as (select *, 1.0::double / count(*) over (partition by symbol) as w from r where x is not null and y is not null), s as (select sum(w) as n, sum(w * x) as x, sum(w * y) as y, sum(w * x * x) as xx, sum(w * x * y) as xy from w)
select 'all' as k, 'log1' as term, round((n * xy - x * y) / (n * xx - x * x), 6) as coefficient from s union all select 'all', 'intercept', round((y - (n * xy - x * y) / (n * xx - x * x) * x) / n, 6) from s""",
    "monthly_progress": f"""with {SCORE_SQL}, s as (select symbol, date_trunc('month', date)::date as month, date, round(score, 6) as score, floor(floor(round(score, 6) * 10 + 0.5) / 10 + 0.5) as shown from scored where score is not null),
m as (select symbol, month, max_by(score, date) as score, count(*) filter (shown <= 24) as fear, count(*) filter (shown >= 75) as greed from s group by 1, 2)
select symbol, month, score, fear, greed, {label_sql('floor(score * 10 + 0.5) / 10')} as label from m a where month < (select max(month) from m b where b.symbol = a.symbol)""",
    "least_squares": f"""with {REGION_SQL}, r as (select symbol, ln(close / lag(close) over w) as x, ln(lead(close, 2) over w / lead(close, 1) over w) as y from region_bars window w as (partition by symbol order by date))
select symbol, 'intercept' as term, round(regr_intercept(y, x), 6) as coefficient from r group by 1 union all select symbol, 'log1', round(regr_slope(y, x), 6) from r group by 1""",
    "ledger_chain": f"""with {ENTRY_SQL}, d as (select *, sha256('{{"cents":' || cents || ',"date":"' || date || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') as digest from entries)
select o_custkey, date, digest, coalesce(lag(digest) over w, sha256(o_custkey::varchar)) as previous, date - lag(date) over w as gap from d window w as (partition by o_custkey order by date)""",
    "ledger_events": f"""with {REGION_SQL}, r as (select symbol, date, lead(date) over w as d1, lead(close) over w as c1, lead(date, 2) over w as d2, lead(close, 2) over w as c2 from region_bars window w as (partition by symbol order by date))
select symbol, date, 'FILL' as kind, d1 as at, round(c1, 6) as value from r where d1 is not null union all select symbol, date, 'OUTCOME', d2, round(ln(c2 / c1), 6) from r where d2 is not null""",
    "ledger_endpoint": f"""with {REGION_SQL}, f as (select * from region_bars qualify row_number() over (partition by symbol order by date) <= 756) select symbol, count(*) = 756 and max(date) - min(date) >= 1095 as complete, count(*) as n, max(date) as last from f group by 1""",
    "chart_round_trip": f"with {REGION_SQL} select symbol, date, round(close, 6) as close from region_bars where symbol <> 'ASIA'",
    "information_table": "select 'PART ' || l_partkey as issuer, lpad(l_partkey::varchar, 9, 'A') as cusip, sum(round(l_extendedprice * 100)::bigint)::bigint as value, sum(l_quantity)::bigint as shares, case when l_linestatus = 'F' then 'Put' end as put_call, sum(l_quantity)::bigint as sole from lineitem group by l_partkey, l_linestatus",
    "filing_list": "select lpad(o_custkey::varchar, 10, '0') as cik, o_orderkey::varchar as accession, '13F-HR' as form, o_orderdate::date as filed, o_orderdate::date as report from orders where o_orderstatus = 'F'",
    "page_fields": "select page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, len(regexp_extract_all(html, '<a[ >]')) as links, len(regexp_extract_all(html, '<p[ >]')) as paragraphs from pages",
    "event_props": "select ts::date as day, event_type, count(*) as n, sum((props->>'$.k')::bigint)::bigint as k_sum from events group by 1, 2",
}
