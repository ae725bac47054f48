"""Readers of filings and gauges: columnar and nested JSON, XML, quoted CSV and fixed-width text, from files or from a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import texts

CHART = "chart struct<result: array<struct<meta: struct<symbol: string, currency: string, exchangeTimezoneName: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
INFO_ROW = "nameOfIssuer string, titleOfClass string, cusip string, value bigint, shrsOrPrnAmt struct<sshPrnamt: bigint, sshPrnamtType: string>, putCall string, investmentDiscretion string, votingAuthority struct<Sole: bigint, Shared: bigint, `None`: bigint>"


def chart_bars(charts: DataFrame, payload: str = "payload", asked: str = "symbol", least: int = 30) -> DataFrame:
    """symbol, date, close from chart documents: local dates, adjusted closes if the series has them throughout, the last of a
    day's values, positive ones only. Series that name another symbol or have fewer than `least` bars give nothing."""
    doc = charts.select(asked, F.from_json(payload, CHART)["chart"]["result"][0].alias("r"))
    same = doc.filter(F.col("r.meta.symbol") == F.col(asked))
    adjusted, raw = F.col("r.indicators.adjclose")[0]["adjclose"], F.col("r.indicators.quote")[0]["close"]
    whole = F.size(F.filter(adjusted, lambda x: x.isNotNull())) == F.size(F.filter(raw, lambda x: x.isNotNull()))
    zone = F.coalesce("r.meta.exchangeTimezoneName", F.lit("UTC"))
    rows = same.select(asked, zone.alias("zone"), F.posexplode(F.arrays_zip(F.col("r.timestamp").alias("at"), F.when(whole, adjusted).otherwise(raw).alias("close"))).alias("i", "v"))
    dated = rows.select(asked, "i", F.to_date(F.from_utc_timestamp(F.timestamp_seconds("v.at"), F.col("zone"))).alias("date"), F.col("v.close").alias("close")).filter("close > 0")
    daily = dated.groupBy(asked, "date").agg(F.max_by("close", "i").alias("close"))
    return daily.join(daily.groupBy(asked).count().filter(F.col("count") >= least).select(asked), asked, "left_semi")


def topped_up(bars: DataFrame, recent: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """bars and the recent bars after their last date, of symbols whose last bar the recent ones repeat within the tolerance."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last"), F.max_by("close", "date").alias("known"))
    agreed = last.join(recent, (last["symbol"] == recent["symbol"]) & (F.col("date") == F.col("last"))).filter(F.abs(F.col("close") / F.col("known") - 1) <= tolerance).select(last["symbol"], "last")
    return bars.unionByName(recent.join(agreed, "symbol").filter("date > last").drop("last"))


def submissions(filings: DataFrame, payload: str = "payload", forms: tuple[str, ...] = ("13F-HR", "13F-HR/A")) -> DataFrame:
    """cik, accession, form, filed, report, accepted, newest first within a filer: filings of the given forms from columnar documents."""
    kind = "cik string, filings struct<recent: struct<accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>, acceptanceDateTime: array<string>>>"
    doc = filings.select(F.from_json(payload, kind).alias("d"))
    r = "d.filings.recent"
    rows = doc.select(texts.cik(F.col("d.cik")).alias("cik"), F.explode(F.arrays_zip(*(F.col(f"{r}.{n}").alias(n) for n in ("accessionNumber", "form", "filingDate", "reportDate", "acceptanceDateTime")))).alias("f"))
    return rows.filter(F.col("f.form").isin(*forms)).select("cik", F.col("f.accessionNumber").alias("accession"), F.col("f.form").alias("form"), texts.sec_date(F.col("f.filingDate")).alias("filed"), texts.sec_date(F.col("f.reportDate")).alias("report"), F.col("f.acceptanceDateTime").alias("accepted"))


def information_table(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """Rows of 13F information tables: with nine-character identifiers; if lenient, short ones are padded and kept as filed."""
    rows = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", "true").schema(INFO_ROW).load(path)
    return _information(rows, lenient)


def information_rows(filings: DataFrame, xml: str = "xml", lenient: bool = False) -> DataFrame:
    """The same from a column that holds one infoTable element per row."""
    kept = [c for c in filings.columns if c != xml]
    return _information(filings.select(*kept, F.from_xml(F.col(xml), INFO_ROW).alias("r")).select(*kept, "r.*"), lenient)


def _information(rows: DataFrame, lenient: bool) -> DataFrame:
    cusip = texts.padded_cusip(F.col("cusip")) if lenient else texts.valid_cusip(F.col("cusip"))
    known = rows.columns[: rows.columns.index("nameOfIssuer")]
    return rows.select(*known, F.col("nameOfIssuer").alias("issuer"), F.col("titleOfClass").alias("title"), cusip.alias("cusip"), F.col("cusip").alias("cusip_as_filed"), "value", F.col("shrsOrPrnAmt.sshPrnamt").alias("shares"), F.col("shrsOrPrnAmt.sshPrnamtType").alias("share_type"), F.col("putCall").alias("put_call"), F.col("votingAuthority.Sole").alias("sole"), F.col("votingAuthority.Shared").alias("shared"), F.col("votingAuthority.None").alias("none"))


NPORT = "genInfo struct<regCik: string, regName: string, seriesId: string, seriesName: string, repPdEnd: string, repPdDate: string>, fundInfo struct<totAssets: double, netAssets: double>, invstOrSecs struct<invstOrSec: array<struct<name: string, lei: string, title: string, cusip: string, identifiers: struct<isin: struct<_value: string>, ticker: struct<_value: string>>, balance: double, units: string, curCd: string, valUSD: double, pctVal: double, payoffProfile: string, assetCat: string, invCountry: string>>>"


def fund_reports(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """Holdings of fund reports (one formData element per row of docs): series, report date, totals, and per holding its
    identifiers, balance and value; names that were cut are replaced by titles that begin with them."""
    kept = [c for c in docs.columns if c != xml]
    doc = docs.select(*kept, F.from_xml(F.col(xml), NPORT, {"attributePrefix": "_"}).alias("d"))
    own = ("cik", "series", "report", "net_assets")
    # what a report has once is read before its holdings become rows
    doc = doc.select(*kept, texts.cik(F.col("d.genInfo.regCik")).alias("cik"), F.col("d.genInfo.seriesId").alias("series"), texts.sec_date(F.col("d.genInfo.repPdDate")).alias("report"), F.col("d.fundInfo.netAssets").alias("net_assets"), F.col("d.invstOrSecs.invstOrSec").alias("held"))
    rows = doc.select(*kept, *own, F.explode("held").alias("h"))
    name = F.when(F.upper("h.title").startswith(F.upper("h.name")), F.col("h.title")).otherwise(F.col("h.name"))
    return rows.select(*kept, *own, name.alias("name"), texts.valid_cusip(F.col("h.cusip")).alias("cusip"), F.col("h.identifiers.isin._value").alias("isin"), F.col("h.identifiers.ticker._value").alias("ticker"), F.col("h.balance").alias("balance"), F.col("h.valUSD").alias("value"), F.col("h.pctVal").alias("pct"), F.col("h.assetCat").alias("category"))


def cash_like(category: Column, name: Column, tickers: tuple[str, ...], ticker: Column) -> Column:
    """Whether a holding stands for cash: by category, by name, or by a list."""
    return F.coalesce(category.isin("STIV", "RA"), F.lit(False)) | F.coalesce(name.rlike("(?i)(money market|treasury obligations|government portfolio)"), F.lit(False)) | F.coalesce(ticker.isin(*tickers), F.lit(False))


def value_in_dollars(value: Column, filed: Column) -> Column:
    """Values were filed in thousands before 2023."""
    return F.when(filed < F.lit("2023-01-03").cast("date"), value * 1000).otherwise(value)


def holdings_csv(spark: SparkSession, path: str) -> DataFrame:
    """Holdings files: quoted CSV with a header; ragged rows fail. Snapshot rows with numbers read."""
    raw = spark.read.csv(path, header=True, mode="FAILFAST", quote='"', escape='"', enforceSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    n = lambda c: texts.strict_number(F.col(c), negative=True).alias(c)
    return raw.select(texts.us_date(F.col("Date")).alias("date"), "Account", F.col("StockTicker").alias("ticker"), texts.valid_cusip(F.col("CUSIP")).alias("cusip"), F.col("SecurityName").alias("name"), *(n(c) for c in ("Shares", "Price", "MarketValue", "Weightings", "NetAssets", "SharesOutstanding")))


def snapshot_problems(rows: DataFrame) -> DataFrame:
    """date, problem: what makes a holdings snapshot unusable."""
    per = rows.groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("Account").alias("accounts"), F.countDistinct("NetAssets").alias("totals"), F.sum("Weightings").alias("weight"), F.sum("MarketValue").alias("mv"), F.max("NetAssets").alias("net"))
    checks = F.array_compact(F.array(
        F.when(F.col("n") != F.col("tickers"), "repeated ticker"), F.when(F.col("accounts") != 1, "several accounts"), F.when(F.col("totals") != 1, "several totals"),
        F.when(~F.col("weight").between(95, 105), "weights"), F.when(F.abs(F.col("mv") / F.col("net") - 1) > 0.01, "values"),
    ))
    return per.select("date", F.explode(checks).alias("problem"))


def text_lines(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, n (from 0), line: the lines of each document."""
    return docs.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("n", "line"))


#: Fixed forms of a text filing's table: the right part of a row (identifier, perhaps a value, shares, their kind, put or call), and a line that holds a row's value, after the rest of its title.
_RIGHT = r"\s{2,}([0-9A-Za-z]{9})\s+(?:([0-9,]+(?:\.[0-9]+)?)\s+)?([0-9,]+)\s+(SH|PRN)\b(?:\s+(PUT|CALL))?.*$"
_WRAPPED = r"^\s+(?:(\S.*?)\s{2,})?([0-9,]+\.[0-9]{2})\s*$"


def fixed_width_13f(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of tables in text filings: keys, n, issuer, title, cusip, value (thousands), shares, share_type, put_call, problem.

    Columns are two spaces or more apart: issuer, title, and the right part. Without a value on the line, it is on the next one, which may go on with the
    title. Rows whose value is nowhere stay, with a problem. lines: keys, n, line."""
    w = Window.partitionBy(*keys).orderBy("n")
    part = lambda c, form, i: F.nullif(F.regexp_extract(c, form, i), F.lit(""))
    rows = lines.select(*keys, "n", "line", F.lead("line").over(w).alias("_next")).filter(F.col("line").rlike(_RIGHT))
    rows = rows.withColumn("_head", F.regexp_replace("line", _RIGHT, "")).filter(F.col("_head").rlike(r"^\S.*\S\s{2,}\S"))
    on_line, wrapped = part("line", _RIGHT, 2), F.when(part("line", _RIGHT, 2).isNull(), part("_next", _WRAPPED, 2))
    title, rest = F.regexp_extract("_head", r"\s{2,}((?:\S| \S)+)\s*$", 1), F.when(wrapped.isNotNull(), part("_next", _WRAPPED, 1))
    value = texts.lenient_number(F.coalesce(on_line, wrapped))
    return rows.select(
        *keys, "n", F.trim(F.regexp_replace("_head", r"\s{2,}(?:\S| \S)+\s*$", "")).alias("issuer"), F.concat_ws(" ", title, F.trim(rest)).alias("title"), F.upper(part("line", _RIGHT, 1)).alias("cusip"),
        value.alias("value"), texts.lenient_number(part("line", _RIGHT, 3)).alias("shares"), part("line", _RIGHT, 4).alias("share_type"), part("line", _RIGHT, 5).alias("put_call"), F.when(value.isNull(), "no value").alias("problem"),
    )


def gauge_history(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """date, score: the last reading of each UTC day from gauge documents with epoch milliseconds."""
    kind = "fear_and_greed_historical struct<data: array<struct<x: double, y: double, rating: string>>>"
    rows = docs.select(F.explode(F.from_json(payload, kind)["fear_and_greed_historical"]["data"]).alias("v"))
    return rows.groupBy(F.to_date(F.timestamp_millis(F.col("v.x").cast("long"))).alias("date")).agg(F.max_by("v.y", "v.x").alias("score"))


def ratios(docs: DataFrame, payload: str = "payload") -> DataFrame:
    """date, name, value of daily ratio documents."""
    rows = docs.select("date", F.explode(F.from_json(payload, "ratios array<struct<name: string, value: string>>")["ratios"]).alias("r"))
    return rows.select("date", F.col("r.name").alias("name"), F.col("r.value").try_cast("double").alias("value"))


def yields_csv(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """date, percent of a two-column file in which a dot is missing, up to a date."""
    rows = spark.read.csv(path, header=True, nullValue=".", schema="date date, percent double")
    return rows.filter((F.col("date") <= F.lit(as_of).cast("date")) & F.col("percent").isNotNull())


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, lang, title, links and paragraphs (counts) of pages, by patterns."""
    return pages.select("page_id", F.regexp_extract(html, r'<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(html, F.lit(r"<a[ >]")).alias("links"), F.regexp_count(html, F.lit(r"<p[ >]")).alias("paragraphs"))


def event_props(events: DataFrame) -> DataFrame:
    """day, event_type, n, k_sum: events by day and type with the number in their JSON."""
    k = F.from_json("props", "k bigint")["k"]
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"))


HEADER = "headerData struct<filerInfo: struct<periodOfReport: string>>, formData struct<coverPage: struct<reportCalendarOrQuarter: string, isAmendment: string, amendmentInfo: struct<amendmentType: string>, filingManager: struct<name: string>, reportType: string>, summaryPage: struct<tableEntryTotal: string, tableValueTotal: string>>"


def filing_headers(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """manager, report date (the quarter's, else the period's), whether and how it amends, kind and declared totals of 13F cover documents."""
    kept = [c for c in docs.columns if c != xml]
    d = docs.select(*kept, F.from_xml(F.col(xml), HEADER, {"ignoreNamespace": "true"}).alias("d"))
    cover, total = "d.formData.coverPage", lambda c: texts.strict_number(F.col(f"d.formData.summaryPage.{c}")).cast("long")
    report = texts.sec_date(F.coalesce(f"{cover}.reportCalendarOrQuarter", "d.headerData.filerInfo.periodOfReport"))
    amends = F.coalesce(F.lower(F.trim(f"{cover}.isAmendment")).isin("true", "1", "yes"), F.lit(False))
    return d.select(*kept, F.col(f"{cover}.filingManager.name").alias("manager"), report.alias("report"), amends.alias("amends"), F.col(f"{cover}.amendmentInfo.amendmentType").alias("amendment_type"), F.col(f"{cover}.reportType").alias("report_type"), total("tableEntryTotal").alias("entries"), total("tableValueTotal").alias("value"))


def latest_readings(docs: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """date, value and label of the latest reading of a gauge document and of the one before it; of equal times the first; no numbers, no reading."""
    rows = docs.select(*keys, F.posexplode(F.from_json(payload, "data array<struct<value: string, value_classification: string, timestamp: string>>")["data"]).alias("i", "r"))
    at, value = F.col("r.timestamp").try_cast("bigint"), F.col("r.value").try_cast("double")
    rows = rows.select(*keys, "i", at.alias("at"), value.alias("value"), F.coalesce("r.value_classification", F.lit("")).alias("label")).filter("at is not null and value is not null and not isnan(value)")
    w = Window.partitionBy(*keys).orderBy(F.desc("at"), "i")
    day = lambda c: F.to_date(F.timestamp_seconds(c))
    both = rows.withColumn("place", F.row_number().over(w)).withColumn("at_before", F.lead("at").over(w)).withColumn("previous", F.lead("value").over(w)).filter("place = 1")
    return both.select(*keys, day(F.col("at")).alias("date"), "value", "label", day(F.col("at_before")).alias("previous_date"), "previous")
