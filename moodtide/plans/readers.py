"""The readers over documents made from the test tables: what was written is read back, and malformed rows give nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..sources import filings as R
from ..sources.bars import REGION_SQL, SLOT_SQL, cents, region_bars, slot_bars, table
from ..streaming import ledger as L
from .sentiment import rounded

SYMBOLS = ["0P0001.ST", "X.L", "X.DE", "X.ST", "BTC-USD", "^VIX", "^STOXX", "^OMXSBGI", "^GSPC", "AAPL"]


def top_up(spark, sf_dir):
    """Bars before 1998 topped up with later ones, which repeat the last bar, but for one region by other values."""
    bars = region_bars(spark, sf_dir)
    recent = bars.filter("date >= '1997-12-01'").withColumn("close", F.when(F.col("symbol") == "ASIA", F.col("close") * 1.01).otherwise(F.col("close")))
    return rounded(R.topped_up(bars.filter("date < '1998-01-01'"), recent), "close")


def gauge_readings(spark, sf_dir):
    """Orders as readings of a gauge, one document for each month and thousand keys, in milliseconds; the day's last counts."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    reading = F.struct((F.unix_millis(day.cast("timestamp")) + k).cast("double").alias("x"), (F.pmod(cents(F.col("o_totalprice")), F.lit(1000)) / 10).alias("y"), F.lit("fear").alias("rating"))
    o = table(spark, sf_dir, "orders").select(F.trunc(day, "month").alias("month"), F.floor(k / 1000).alias("page"), reading.alias("r"))
    docs = o.groupBy("month", "page").agg(F.to_json(F.struct(F.struct(F.collect_list("r").alias("data")).alias("fear_and_greed_historical"))).alias("payload"))
    return R.gauge_history(docs)


def ratio_readings(spark, sf_dir):
    """Slots of a day as one document of named ratios, whose values are texts and no numbers on the thirteenth."""
    text = F.when(F.dayofmonth("date") == 13, "n/a").otherwise(F.floor(F.col("close") * 100).cast("string"))
    docs = slot_bars(spark, sf_dir).groupBy("date").agg(F.collect_list(F.struct(F.col("symbol").alias("name"), text.alias("value"))).alias("ratios"))
    return R.ratios(docs.select("date", F.to_json(F.struct("ratios")).alias("payload")))


def fixed_width_rows(spark, sf_dir):
    """Parts' order lines as text filings in both layouts: values on the line, with decimals, or on the next one with the rest of the title; identifiers of eight characters are no rows, and some values are nowhere."""
    parts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("c"), F.sum("l_quantity").cast("long").alias("q"))
    k = F.col("l_partkey")
    key = F.concat(F.lpad(k.cast("string"), 7, "0"), F.when(k % 4 == 3, "ab").otherwise("AB"))
    cusip = F.when(k % 7 == 0, F.substring(key, 2, 8)).otherwise(key)
    name = F.rpad(F.concat(F.lit("PART "), k, F.lit(" COMPANY  OF  ROWS")), 40, " ")
    value = F.when(k % 4 == 1, F.format_number(F.col("c") / 100, 2)).otherwise(F.format_number(F.col("c") / 100, 0))
    whole = F.concat(name, F.lit("COM NEW   "), cusip, F.lit("  "), value, F.lit("  "), F.format_number("q", 0), F.lit(" SH"), F.when(k % 5 == 0, " CALL").otherwise(" SOLE"))
    wrapped = F.concat(name, F.lit("SPON ADR   "), cusip, F.lit("  "), F.format_number("q", 0), F.lit("  PRN"))
    below = F.when(k % 29 == 0, "    OTHER TEXT").otherwise(F.concat(F.lit("       SER A    "), F.format_number(F.col("c") / 100, 2)))
    line = F.when(k % 4 == 2, F.concat_ws("\n", wrapped, below)).otherwise(whole)
    file = F.floor(k / 400)  # so many rows a document
    docs = parts.groupBy(file.alias("file")).agg(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("line")))).alias("r"))
    text = F.concat(F.lit("FORM 13F INFORMATION TABLE\r\n\r\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\r\n"))
    return R.fixed_width_13f(R.text_lines(docs.select("file", text.alias("text")), ["file"]), ["file"]).drop("n")


def padded_information(spark, sf_dir):
    """Information tables whose identifiers lost their zeros, hold spaces, or are too short or too long: padded, null if they are none, and kept as filed."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("q"), F.sum(cents(F.col("l_extendedprice"))).alias("c"))
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    k = F.lpad(F.col("l_partkey").cast("string"), 6, "0")
    own = F.get(F.array(F.concat(F.lit("8"), k, F.lit("2")), k, F.concat(F.lit("a"), F.substring(k, 1, 3), F.lit(" "), F.substring(k, 4, 3)), F.concat(k, F.lit("1234")), F.substring(k, 2, 5)), F.pmod("l_partkey", F.lit(5)).cast("int"))
    xml = tag("infoTable", F.concat(tag("nameOfIssuer", F.concat(F.lit("PART "), "l_partkey")), tag("cusip", own), tag("value", F.col("c").cast("string")), tag("shrsOrPrnAmt", tag("sshPrnamt", F.col("q").cast("string")))))
    return R.information_rows(lines.select(xml.alias("xml")), lenient=True).select("issuer", "cusip", "cusip_as_filed", "value", "shares")


def first_entries(spark, sf_dir):
    """The first order of a customer in each month: later ones of that month change nothing."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month"), F.to_date("o_orderdate").alias("day"), "o_orderkey")
    return L.first_wins(o, ["o_custkey", "month"], ["day", "o_orderkey"])


def venues(spark, sf_dir):
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("s_suppkey") % 10 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").groupBy(symbol.alias("symbol")).agg(F.count("*").alias("n")).withColumn("venue", texts.venue(F.col("symbol")))


def cash_rows(spark, sf_dir):
    """Parts as holdings of some categories; some are cash by category, by name or by a list."""
    k = F.col("p_partkey")
    category = F.element_at(F.array(*map(F.lit, ("EC", "STIV", "EC", "RA", "DBT", "EC"))), (k % 6 + 1).cast("int"))
    name = F.when(k % 5 == 0, F.concat("p_brand", F.lit(" Treasury Obligations Fund"))).when(k % 17 != 0, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", R.cash_like(F.when(k % 11 != 0, category), name, ("P13", "P14"), F.concat(F.lit("P"), k)).alias("cash"))


def _tag(name, value):
    return F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))


def filing_headers(spark, sf_dir):
    """Cover documents of orders: some amend, some name the period in the header only, a total of some isn't a number."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "MM-dd-yyyy")
    quarter = F.when(k % 3 != 0, _tag("reportCalendarOrQuarter", day)).otherwise("")
    amends = F.when(k % 4 == 0, F.lit("<isAmendment>true</isAmendment><amendmentInfo><amendmentType>RESTATEMENT</amendmentType></amendmentInfo>")).when(k % 4 == 1, "<isAmendment>false</isAmendment>").otherwise("")
    total = F.when(k % 10 == 0, "many").otherwise(cents(F.col("o_totalprice")).cast("string"))
    cover = _tag("coverPage", F.concat(quarter, amends, _tag("filingManager", _tag("name", F.concat(F.lit("Manager "), "o_custkey"))), F.lit("<reportType>13F HOLDINGS REPORT</reportType>")))
    form = _tag("formData", F.concat(cover, _tag("summaryPage", F.concat(_tag("tableEntryTotal", (k % 50).cast("string")), _tag("tableValueTotal", total)))))
    xml = _tag("edgarSubmission", F.concat(_tag("headerData", _tag("filerInfo", _tag("periodOfReport", day))), form))
    return R.filing_headers(table(spark, sf_dir, "orders").select("o_orderkey", xml.alias("xml")))


def fund_holdings(spark, sf_dir):
    """Lines of an order as a fund's report in XML; names of even parts are cut and completed from the title."""
    c = cents(F.col("l_extendedprice"))

    def holding(x):
        k = x["k"].cast("string")
        title = F.concat(F.lit("PART "), k, F.lit(" ORDINARY"))
        cusip = F.when(x["k"] % 5 != 0, F.lpad(k, 9, "0")).otherwise("N/A")
        fields = [_tag("name", F.when(x["k"] % 2 == 0, F.concat(F.lit("Part "), k)).otherwise("Other")), _tag("title", title), _tag("cusip", cusip), F.concat(F.lit('<identifiers><isin value="US'), k, F.lit('"/></identifiers>'))]
        fields += [_tag("balance", x["q"].cast("string")), _tag("valUSD", x["c"].cast("string")), F.lit("<assetCat>EC</assetCat>")]
        return _tag("invstOrSec", F.concat(*fields))

    # numbers are brought together by order, and become text only then
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate", c.alias("c"), F.struct(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("q"), c.alias("c")).alias("x"))
    docs = lines.groupBy("l_orderkey").agg(F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("d"), F.sum("c").cast("string").alias("t"), F.collect_list("x").alias("x"))
    docs = docs.withColumn("x", F.array_join(F.transform("x", holding), ""))
    info = F.concat(F.lit("<genInfo><regCik>77</regCik><seriesId>S1</seriesId>"), _tag("repPdDate", F.col("d")), F.lit("</genInfo>"), _tag("fundInfo", _tag("netAssets", F.col("t"))))
    rows = R.fund_reports(docs.select("l_orderkey", _tag("formData", F.concat(info, _tag("invstOrSecs", F.col("x")))).alias("xml")))
    return rows.select("l_orderkey", "cik", "series", "report", "net_assets", "name", "cusip", "isin", "balance", "value", "category")


def latest_readings(spark, sf_dir):
    """A customer's orders as readings, one document for each thousand keys; some are no numbers."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    value = F.when(k % 8 == 0, "n/a").otherwise((cents(F.col("o_totalprice")) % 101).cast("string"))
    reading = F.struct(k.alias("k"), value.alias("value"), F.concat(F.lit("c"), k % 5).alias("value_classification"), F.unix_seconds(day.cast("timestamp")).cast("string").alias("timestamp"))
    docs = table(spark, sf_dir, "orders").groupBy("o_custkey", F.floor(k / 1000).alias("page")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(reading)).alias("data"))).alias("payload"))
    return R.latest_readings(docs, ["o_custkey", "page"])


QUERIES = {f.__name__: f for f in (top_up, gauge_readings, ratio_readings, fixed_width_rows, padded_information, first_entries, venues, cash_rows, filing_headers, fund_holdings, latest_readings)}

_PARTS = "with p as (select l_partkey as k, sum(round(l_extendedprice * 100)::bigint)::bigint as c, sum(l_quantity)::bigint as q from lineitem group by 1)"
ORACLES = {
    "top_up": f"with {REGION_SQL} select symbol, date, round(close, 6) as close from region_bars where symbol <> 'ASIA' or date < date '1998-01-01'",
    "gauge_readings": "select o_orderdate::date as date, arg_max((round(o_totalprice * 100)::bigint % 1000)::double / 10, o_orderkey) as score from orders group by 1",
    "ratio_readings": f"with {SLOT_SQL} select date, symbol as name, case when day(date) <> 13 then floor(close * 100)::double end as value from slot_bars",
    "fixed_width_rows": f"""{_PARTS} select floor(k / 400)::bigint as file, 'PART ' || k || ' COMPANY  OF  ROWS' as issuer, case when k % 4 <> 2 then 'COM NEW' when k % 29 = 0 then 'SPON ADR' else 'SPON ADR SER A' end as title, lpad(k::varchar, 7, '0') || 'AB' as cusip,
case when k % 4 = 1 then round(c / 100.0, 2)::double when k % 4 <> 2 then round_even(c / 100.0, 0)::double when k % 29 <> 0 then round(c / 100.0, 2)::double end as value, q::double as shares, case when k % 4 = 2 then 'PRN' else 'SH' end as share_type,
case when k % 4 <> 2 and k % 5 = 0 then 'CALL' end as put_call, case when k % 4 = 2 and k % 29 = 0 then 'no value' end as problem from p where k % 7 <> 0""",
    "padded_information": f"""{_PARTS}, i as (select *, lpad(k::varchar, 6, '0') as s from p) select 'PART ' || k as issuer, case k % 5 when 0 then '08' || s || '2' when 1 then '000' || s when 2 then '00A' || s end as cusip,
case k % 5 when 0 then '8' || s || '2' when 1 then s when 2 then 'a' || s[1:3] || ' ' || s[4:6] when 3 then s || '1234' else s[2:6] end as cusip_as_filed, c as value, q as shares from i""",
    "first_entries": "select o_custkey, date_trunc('month', o_orderdate)::date as month, o_orderdate::date as day, o_orderkey from orders qualify row_number() over (partition by o_custkey, date_trunc('month', o_orderdate) order by o_orderdate::date, o_orderkey) = 1",
    "venues": """select symbol, count(*) as n, case symbol when '0P0001.ST' then 'Stockholm fund NAV' when 'X.L' then 'London-listed' when 'X.DE' then 'Xetra-listed' when 'X.ST' then 'Stockholm-listed' when 'BTC-USD' then 'crypto'
  when '^STOXX' then 'STOXX Europe index' when '^OMXSBGI' then 'Stockholm-listed' when '^GSPC' then 'index' else 'US-listed' end as venue
from (select ['0P0001.ST', 'X.L', 'X.DE', 'X.ST', 'BTC-USD', '^VIX', '^STOXX', '^OMXSBGI', '^GSPC', 'AAPL'][(s_suppkey % 10 + 1)::int] as symbol from supplier) group by 1""",
    "cash_rows": "select p_partkey, (p_partkey % 11 <> 0 and p_partkey % 6 in (1, 3)) or p_partkey % 5 = 0 or p_partkey in (13, 14) as cash from part",
    "filing_headers": """select o_orderkey, 'Manager ' || o_custkey as manager, o_orderdate::date as report, o_orderkey % 4 = 0 as amends, case when o_orderkey % 4 = 0 then 'RESTATEMENT' end as amendment_type,
'13F HOLDINGS REPORT' as report_type, o_orderkey % 50 as entries, case when o_orderkey % 10 <> 0 then round(o_totalprice * 100)::bigint end as value from orders""",
    "fund_holdings": """with l as (select l_orderkey, l_partkey as k, l_shipdate::date as d, round(l_extendedprice * 100)::bigint as c, l_quantity::bigint as q from lineitem)
select l_orderkey, '0000000077' as cik, 'S1' as series, max(d) over w as report, (sum(c) over w)::double as net_assets, case when k % 2 = 0 then 'PART ' || k || ' ORDINARY' else 'Other' end as name,
case when k % 5 <> 0 then lpad(k::varchar, 9, '0') end as cusip, 'US' || k as isin, q::double as balance, c::double as value, 'EC' as category from l window w as (partition by l_orderkey)""",
    "latest_readings": """with r as (select o_custkey, o_orderkey // 1000 as page, o_orderdate::date as d, o_orderkey as k, ((round(o_totalprice * 100)::bigint) % 101)::double as v from orders where o_orderkey % 8 <> 0)
select o_custkey, page, d as date, v as value, 'c' || k % 5 as label, lead(d) over w as previous_date, lead(v) over w as previous from r
window w as (partition by o_custkey, page order by d desc, k) qualify row_number() over w = 1""",
}
