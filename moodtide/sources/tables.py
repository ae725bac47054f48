"""Delimited files by the names in their headers: holdings, net asset values, performance, gauges, yields. Columns may stand in any order and number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import texts
from ..operators.lineage import cut

_HOW = {"multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_ragged", "nullValue": ""}


def header(spark: SparkSession, path: str) -> list[str]:
    """The names in a file's first row; the files of a folder share them."""
    first = spark.read.options(**_HOW).csv(path).limit(1).collect()
    return [(x or "").lstrip("﻿").strip() for x in first[0]] if first else []


def quoted_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The wanted columns as texts, by name and header, and problems: headers that are empty, repeated or missing, and rows of another number of fields, which are left out.

    Quotes may hold line ends, commas and doubled quotes. A file begins with a mark of its encoding or without. If a header doesn't serve, there are no rows."""
    names = header(spark, path)
    wrong = [f"repeated header {n}" for n in dict.fromkeys(names) if n and names.count(n) > 1] + ["empty header"] * ("" in names) + [f"no column {h}" for h in columns.values() if h not in names]
    problems = spark.createDataFrame([(None, w) for w in wrong], "row string, problem string")
    kind = ", ".join([*(f"c{i} string" for i in range(max(1, len(names)))), "_ragged string"])
    raw = spark.read.options(**_HOW, header="true", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true").schema(kind).csv(path)
    if wrong:
        return raw.limit(0).select(*(F.lit(None).cast("string").alias(c) for c in columns)), problems
    rows = raw.filter("_ragged is null").select(*(F.col(f"c{names.index(h)}").alias(c) for c, h in columns.items()))
    # Spark doesn't read the text of such rows alone, so they are written before anyone asks for less
    ragged = cut(raw.filter("_ragged is not null").select("_ragged", "c0"))
    return rows, problems.unionByName(ragged.select(F.col("_ragged").alias("row"), F.lit("ragged row").alias("problem")))


def number(c: str) -> Column:
    return texts.strict_number(F.col(c), negative=True).alias(c)


#: Columns of holdings files by their headers.
HOLDINGS = {"date": "Date", "account": "Account", "ticker": "StockTicker", "cusip": "CUSIP", "name": "SecurityName", "shares": "Shares", "price": "Price", "value": "MarketValue", "weight": "Weightings", "net": "NetAssets", "units": "SharesOutstanding"}


def holdings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rows of holdings files with dates and numbers read, and problems."""
    rows, problems = quoted_csv(spark, path, HOLDINGS)
    return rows.select(texts.us_date(F.col("date")).alias("date"), "account", "ticker", texts.valid_cusip(F.col("cusip")).alias("cusip"), "name", *(number(c) for c in ("shares", "price", "value", "weight", "net", "units"))), problems


def snapshot_problems(rows: DataFrame) -> DataFrame:
    """date, problem: what makes a holdings snapshot unusable: a ticker twice, several accounts or totals, weights that don't make 95 to 105 %, values beyond 1 % of the total, numbers that are none."""
    per = rows.groupBy("date").agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"), F.countDistinct("account").alias("accounts"), F.countDistinct("net").alias("totals"), F.sum("weight").alias("weight"), F.sum("value").alias("mv"), F.max("net").alias("total"), F.sum((F.col("shares").isNull() | F.col("value").isNull()).cast("int")).alias("odd"))
    checks = F.array_compact(F.array(
        F.when(F.col("n") != F.col("tickers"), "repeated ticker"), F.when(F.col("accounts") != 1, "several accounts"), F.when(F.col("totals") != 1, "several totals"),
        F.when(~F.col("weight").between(95, 105), "weights"), F.when(F.abs(F.col("mv") / F.col("total") - 1) > 0.01, "values"), F.when(F.col("odd") > 0, "no number"),
    ))
    return per.select("date", F.explode(checks).alias("problem"))


def dated(spark: SparkSession, path: str, columns: dict[str, str], missing: str = ".", as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """date and numbers of a file with a column of dates (ISO or US) named first; `missing` and empty fields are null, rows without a date or without any number go, and rows after `as_of`."""
    rows, problems = quoted_csv(spark, path, columns)
    first, *others = columns
    day = F.coalesce(F.try_to_date(F.col(first), "yyyy-MM-dd"), texts.us_date(F.col(first)))
    read = rows.select(day.alias("date"), *(F.when(F.col(c) != missing, number(c)).alias(c) for c in others)).filter(F.col("date").isNotNull() & F.coalesce(*others).isNotNull())
    return read.filter(F.col("date") <= F.lit(as_of).cast("date")) if as_of else read, problems


def merged_nav(daily: DataFrame, history: DataFrame) -> DataFrame:
    """Daily net asset values with what the history says of the same date and value: its other columns fill those that the daily file lacks."""
    own = [c for c in daily.columns if c not in ("date", "nav")]
    other = [c for c in history.columns if c not in ("date", "nav")]
    both = daily.join(history.select("date", "nav", *(F.col(c).alias(f"_{c}") for c in other)), ["date", "nav"], "left")
    return both.select("date", "nav", *(F.coalesce(c, f"_{c}").alias(c) if c in other else F.col(c) for c in own), *(F.col(f"_{c}").alias(c) for c in other if c not in own))
